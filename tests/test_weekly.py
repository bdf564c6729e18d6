"""Cleaning, the fact table and its edge cases."""

import datetime as dt
import random

import pytest
from conftest import SF, plan
from pyspark.sql import functions as F

from spendtide.operators import clean, weekly
from spendtide.plans import catalog, starschema
from spendtide.schemas import RAW_CREATIVES, WEEKLY_SIGNALS, conform


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_midpoint_sum(creatives):
    row = one(weekly.weekly_signals(creatives([
        dict(spend_lower=100.0, spend_upper=300.0),
        dict(spend_lower=0.0, spend_upper=100.0, is_active=False),
    ])))
    assert (row.spend_midpoint, row.ad_count, row.active_ad_count) == (250.0, 2, 1)


def test_missing_bound_counts_as_zero(creatives):
    df = creatives([dict(spend_lower=None, spend_upper=100.0)])
    assert one(clean.clean_creatives(df)).spend_midpoint == 50.0
    assert one(clean.add_spend_midpoint(df)).spend_midpoint == 50.0
    assert one(weekly.weekly_signals(df)).spend_midpoint == 50.0


def test_nan_spend_is_missing(creatives):
    assert one(weekly.weekly_signals(creatives([dict(spend_lower=float("nan"), spend_upper=10.0)]))).spend_midpoint == 5.0


def test_infinite_spend_is_missing(creatives):
    assert one(weekly.weekly_signals(creatives([dict(spend_lower=float("inf"), spend_upper=10.0)]))).spend_midpoint == 5.0


def test_absurd_and_tiny_spend(creatives):
    rows = [dict(spend_lower=1e300, spend_upper=10.0), dict(spend_lower=0.000001, spend_upper=0.000003)]
    assert one(weekly.weekly_signals(creatives(rows))).spend_midpoint == 5.000002
    assert one(clean.bad_amounts(creatives(rows))).asDict() == dict(spend_lower=1, spend_upper=0)
    many = [dict(source_id=str(i), spend_upper=1e12) for i in range(60)]  # 6e19 units: past a bigint
    assert one(weekly.weekly_signals(creatives(many))).spend_midpoint == 3e13


def test_unknown_and_emptied_labels_are_left_out(creatives):
    df = clean.clean_creatives(creatives([dict(creative_themes=["unknown"], cta="\u200b "), dict(creative_themes=["a"], cta="Go")]))
    row = one(weekly.weekly_signals(df))
    assert (row.top_themes, row.top_ctas) == (["a"], ["Go"])
    assert [r.theme for r in weekly.top_themes(df).collect()] == ["a"]


def test_week_is_derived_from_the_start(creatives):
    rows = [dict(week_key=None, started_running="2024-12-30"), dict(week_key="", started_running="x"), dict(week_key="2020-W01", started_running="2024-01-01")]
    got = [r.week_key for r in clean.clean_creatives(creatives(rows)).orderBy("source_id").collect()]
    assert got == ["2025-W01", None, "2020-W01"]


def test_week_without_spend_has_share_zero(creatives):
    rows = weekly.weekly_signals(creatives([dict(), dict(channel="video")])).collect()
    assert [r.channel_share for r in rows] == [0.0, 0.0]


def test_missing_active_flag(creatives):
    assert one(weekly.weekly_signals(creatives([dict(is_active=None)]))).active_ad_count == 0


def test_bad_dates_stay_as_null(creatives):
    df = creatives([
        dict(started_running="garbage", ingested_at=""),
        dict(started_running="", stopped_running="2024-02-30", ingested_at="soon"),
        dict(started_running="2024-2-3", stopped_running="2024-02-04T10:00:00", ingested_at="2024-02-03T01:02:03"),
    ])
    rows = clean.cast_dates(df).orderBy("source_id").collect()
    assert [r.started_running for r in rows] == [None, None, dt.date(2024, 2, 3)]
    assert [r.stopped_running for r in rows] == [None, None, dt.date(2024, 2, 4)]
    assert [r.ingested_at is None for r in rows] == [True, True, False]
    assert one(clean.bad_dates(df)).asDict() == dict(started_running=2, stopped_running=1, ingested_at=2)


def test_top_lists_are_ranked_distinct_and_bounded(creatives):
    ctas = ["Buy"] * 3 + ["Shop", "Shop", "Learn", "Apply", None, "unknown", "unknown", "unknown", "unknown"]
    rows = [dict(cta=c, creative_themes=["b", "a", None] if i < 5 else ["c", "d", "e", "f"]) for i, c in enumerate(ctas)]
    row = one(weekly.weekly_signals(creatives(rows)))
    assert row.top_ctas == ["Buy", "Shop", "Apply"]
    assert row.top_themes == ["c", "d", "e", "f", "a"]


def test_missing_lists_and_region(creatives):
    row = one(weekly.weekly_signals(creatives([dict(region=None, creative_themes=None, cta=None)])))
    assert (row.region, row.top_ctas, row.top_themes) == ("unknown", [], [])


def test_empty_in_empty_out(creatives):
    empty = creatives([dict()]).limit(0)
    assert weekly.weekly_signals(empty).count() == 0
    assert weekly.weekly_measures(empty).count() == 0


def test_shares_sum_to_one(spark):
    s = weekly.weekly_measures(starschema.creatives(spark, SF))
    totals = s.groupBy("brand", "week_key").agg(F.sum("channel_share").alias("t"), F.sum("spend_midpoint").alias("m"))
    assert totals.filter((F.col("m") > 0) & (F.abs(F.col("t") - 1) > 1e-6)).count() == 0


def test_share_total_adds_regions(creatives):
    df = creatives([
        dict(spend_upper=20.0), dict(region="UK", spend_upper=60.0), dict(channel="video", spend_upper=20.0),
    ])
    rows = weekly.attach_total(weekly.weekly_measures(df)).collect()
    got = {(r.channel, r.region): (r.channel_share, r.channel_share_total, r.brand_week_spend) for r in rows}
    assert got[("social", "US")] == (0.2, 0.8, 50.0)
    assert got[("social", "UK")] == (0.6, 0.8, 50.0)
    assert got[("video", "US")] == (0.2, 0.2, 50.0)


def test_batch_stamp_and_target_types(spark, creatives):
    stamp = F.lit("2024-05-01 00:00:00").cast("timestamp")
    out = conform(weekly.weekly_signals(creatives([dict()]), stamp), WEEKLY_SIGNALS)
    assert out.columns == WEEKLY_SIGNALS.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in WEEKLY_SIGNALS]
    assert one(out).etl_timestamp == dt.datetime(2024, 5, 1)
    assert "etl_timestamp" not in weekly.weekly_signals(creatives([dict()])).columns


def test_conform_adds_reorders_and_casts(spark):
    df = spark.createDataFrame([("9", float("nan"), "x")], "impression_lower string, spend_lower double, brand string")
    row = one(conform(df, RAW_CREATIVES))
    assert list(row.asDict()) == RAW_CREATIVES.names
    assert (row.impression_lower, row.spend_lower, row.brand, row.currency) == (9, None, "x", None)


def test_channel_lists(creatives):
    df = creatives([dict(), dict(channel="video"), dict(brand="other")])
    assert clean.filter_brand_channels(df, "acme").count() == 2
    assert clean.filter_brand_channels(df, "acme", ["video", "tv"]).count() == 1
    assert clean.filter_brand_channels(df, "acme", []).count() == 0


def test_sanitized_columns(creatives):
    row = one(clean.clean_creatives(creatives([dict(ad_text="a\u200bb", cta="Buy\ufeff", creative_themes=["x\u2060", None])])))
    assert (row.ad_text, row.cta, row.creative_themes) == ("ab", "Buy", ["x", None])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python_with_a_hot_group(creatives, seed):
    """A third of all rows sit in one group, most of their values distinct."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        hot = i % 3 == 0
        rows.append(dict(
            brand="acme" if hot else rng.choice("bcd"),
            week_key="2024-W01" if hot else f"2024-W{rng.randint(1, 5):02d}",
            channel="social" if hot else rng.choice(["video", "ctv"]),
            region="US" if hot else rng.choice(["US", "UK", None]),
            cta=f"cta{i}" if hot and i % 2 else rng.choice(["Buy", "Go", None, "unknown"]),
            creative_themes=[f"t{rng.randint(0, 300)}" for _ in range(rng.randint(0, 3))],
            spend_lower=rng.choice([None, round(rng.random() * 100, 2)]), spend_upper=round(rng.random() * 1000, 2),
            impression_upper=rng.randint(0, 99), is_active=rng.choice([True, False, None]),
        ))
    want = {}
    for r in rows:
        g = want.setdefault((r["brand"], r["week_key"], r["channel"], r["region"] or "unknown"), [0, 0, 0, 0.0, {}, {}])
        g[0] += 1
        g[1] += bool(r["is_active"])
        g[2] += r["impression_upper"]
        g[3] += ((r["spend_lower"] or 0) + r["spend_upper"]) / 2
        if r["cta"] not in (None, "unknown"):
            g[4][r["cta"]] = g[4].get(r["cta"], 0) + 1
        for t in r["creative_themes"]:
            g[5][t] = g[5].get(t, 0) + 1
    got = {(r.brand, r.week_key, r.channel, r.region): r for r in weekly.weekly_signals(creatives(rows)).collect()}
    assert got.keys() == want.keys()
    totals = {}
    for k, g in want.items():
        totals[k[:2]] = totals.get(k[:2], 0) + g[3]
    for k, (n, active, imp, mid, ctas, themes) in want.items():
        r = got[k]
        assert (r.ad_count, r.active_ad_count, r.impression_upper_sum) == (n, active, imp)
        assert r.spend_midpoint == pytest.approx(mid)
        assert r.channel_share == pytest.approx(mid / totals[k[:2]])
        assert r.top_ctas == [v for v, _ in sorted(ctas.items(), key=lambda e: (-e[1], e[0]))[:3]]
        assert r.top_themes == [v for v, _ in sorted(themes.items(), key=lambda e: (-e[1], e[0]))[:5]]


def test_plan_reduces_before_each_shuffle(spark):
    p = plan(weekly.weekly_signals(starschema.creatives(spark, SF)))
    assert "collect_list(cta" not in p and "CartesianProduct" not in p and "NestedLoop" not in p
    assert p.count("WindowGroupLimit") == 2          # before and after the ranking shuffle
    assert "partial_sum(spend_lower" in p
    assert "PartialMerge" not in p
    registered = plan(catalog.full_signals(spark, SF))
    assert "l_orderkey" not in registered and registered.count("FileScan") == 3  # of the written input
    scans = [line for line in p.splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert all("l_tax" not in line for line in scans)
