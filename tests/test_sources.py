"""Documents, archive ads, text files, tables, snapshots and the weekly run."""

import datetime as dt
import json
import os
import random
import time

import pytest
from conftest import SF, plan, weeks
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spendtide import session
from spendtide.functions import labels
from spendtide.operators import clean, dedup, weekly
from spendtide.plans import catalog, starschema
from spendtide.plans.weekly_run import weekly_run
from spendtide.schemas import RAW_CREATIVES, WEEKLY_SIGNALS
from spendtide.session import shared_dir, staged
from spendtide.sources import archive, loads, snapshots, tables, textfiles
from spendtide.sources import creatives as docs
from spendtide.streaming import feeds


def stamps():
    return F.lit("2024-06-05").cast("date"), F.lit("2024-06-05 01:00:00").cast("timestamp")


# ---- documents ------------------------------------------------------------------------


def test_json_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_id": "1", "source": "meta", "brand": "b", "spend_lower": 1.5}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"source_id": "2", "creative_themes": ["x"], "extra": 1}) + "\n")
    rows = docs.scan_all(spark, str(tmp_path)).orderBy("source_id").collect()
    assert rows[0].asDict().keys() == set(RAW_CREATIVES.names)
    assert (rows[0].spend_lower, rows[0].cta, rows[1].brand, rows[1].creative_themes) == (1.5, None, None, ["x"])


def test_recent_documents(creatives):
    df = creatives([dict(ingested_at=f"2024-01-{d:02d}") for d in (3, 1, 2)] + [dict(brand="other"), dict(ingested_at=None)])
    got = docs.brand_recent_creatives(df, "ACME", 2).collect()
    assert [r.ingested_at for r in got] == ["2024-01-03", "2024-01-02"]
    assert docs.brand_recent_creatives(df, "acme", 10).count() == 4


def test_recent_documents_are_cut_before_the_sort(creatives):
    rng = random.Random(1)
    days = [f"2024-01-{rng.randint(1, 28):02d}" for _ in range(500)]
    df = creatives([dict(ingested_at=d) for d in days]).repartition(7)
    got = docs.brand_recent_creatives(df, "acme", 60)
    want = sorted(((d, str(i)) for i, d in enumerate(days)), key=lambda e: (-int(e[0][-2:]), e[1]))[:60]
    assert "LeftSemi" in plan(got) and "TakeOrderedAndProject" in plan(got)
    assert [(r.ingested_at, r.source_id) for r in got.collect()] == want


def test_relabel(creatives):
    df = creatives([dict(channel=c, platform="p") for c in ("search", "social", "video", "display", "ctv")])
    rows = {r.channel: r for r in docs.relabel_search_source(df).collect()}
    for c in ("search", "video", "display"):
        assert rows[c].source == "google" and rows[c].platform in labels.SEARCH_PLATFORMS
    for c in ("social", "ctv"):
        assert (rows[c].source, rows[c].platform) == ("meta", "p")


# ---- archive --------------------------------------------------------------------------


def normal(spark, *ads, brand="Coca-Cola Zero"):
    df = spark.createDataFrame([(brand, json.dumps(a)) for a in ads], "brand string, json string")
    return archive.normalise_ads(archive.parse_ads(df, "json"), *stamps()).collect()


def test_bare_ad(spark):
    r = normal(spark, {"id": "77-b", "ad_creative_body": "Su\u2066mmer\u2069 \U000e0041sale"})[0]
    assert r.asDict() == dict(
        source_id="77-b", source="meta", brand="coca-cola-zero", brand_display="Coca-Cola Zero", ad_text="Summer sale",
        cta="Learn More", channel="social", platform="facebook", impression_lower=0, impression_upper=0,
        spend_lower=0.0, spend_upper=0.0, started_running=dt.date(2024, 6, 5), stopped_running=None, is_active=True,
        currency="USD", region="US", creative_themes=[], ingested_at=dt.datetime(2024, 6, 5, 1), week_key="2024-W23",
    )


def test_full_and_broken_ads(spark):
    full = {
        "id": "1", "ad_delivery_start_time": "2024-12-30T08:00:00+0000", "ad_delivery_stop_time": "2099-01-01",
        "impressions": {"lower_bound": "1000", "upper_bound": "4999"}, "spend": {"lower_bound": "100", "upper_bound": 199.5, "currency": "EUR"},
        "publisher_platforms": ["audience_network", "facebook"],
    }
    bad = {"id": "2", "ad_delivery_start_time": "soon", "ad_delivery_stop_time": "never", "publisher_platforms": []}
    a, b, c = normal(spark, full, bad, {})
    assert (a.week_key, a.is_active, a.impression_upper, a.spend_upper, a.currency, a.channel, a.platform) == (
        "2025-W01", False, 4999, 199.5, "EUR", "display", "audience_network")
    assert (b.started_running, b.stopped_running, b.is_active, b.platform) == (dt.date(2024, 6, 5), None, True, "facebook")
    assert (c.source_id, c.ad_text) == ("", "")


def test_pages(spark, tmp_path):
    for i in range(4):
        page = {"data": [{"id": f"{i}-{j}"} for j in range(3)], "paging": {"next": "u"}, "brand": "b", "page_index": i}
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    got = archive.explode_ad_pages(archive.read_pages(spark, str(tmp_path)), 2)
    assert sorted(r.ad.id for r in got.collect()) == [f"{i}-{j}" for i in range(2) for j in range(3)]
    assert {r.brand for r in archive.normalise_ads(got, *stamps()).collect()} == {"b"}


# ---- text files -----------------------------------------------------------------------


def test_tree(spark, tmp_path):
    mark = "\U000e0020"
    scanned = ("notes.mdx", "_setup.cfg", ".dot/conf.TOML", "one/two/three/log.txt")
    for name in (*scanned, "dist/x.py", "one/venv/y.js", "photo.jpg", ".sh"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"first\nse{mark}cond\n", encoding="utf-8")
    (tmp_path / "mixed.ini").write_bytes(f"1\r\n\r3{mark}{mark}\n".encode())
    (tmp_path / "plain.yml").write_text("a: 1\n")
    got = sorted((r.file, r.line, r.col, r.code_point) for r in textfiles.scan_text_files(spark, str(tmp_path)).collect())
    want = [(n, 2, 3, "U+E0020") for n in scanned] + [("mixed.ini", 3, 2, "U+E0020"), ("mixed.ini", 3, 3, "U+E0020")]
    assert got == sorted(want)


def test_links_unreadable_files_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textfiles, "PART", 7)  # lines, line ends and letters are cut anywhere
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "loop").symlink_to(tmp_path / "in", target_is_directory=True)
    text = "äö\r\nx\u200by\r\n" * 40
    (tmp_path / "in" / "a.txt").write_bytes(text.encode())
    (tmp_path / "broken.md").write_bytes(b"ok \xff\xfe")
    rows = textfiles.scan_all_text(spark, str(tmp_path)).collect()
    hits = sorted((r.file, r.line, r.col) for r in rows if r.error is None)
    assert hits == [("in/a.txt", 2 * i, 2) for i in range(1, 41)]
    assert [(r.file, "UnicodeDecodeError" in r.error) for r in rows if r.error] == [("broken.md", True)]
    gone = textfiles.scan_all_text(spark, str(tmp_path / "nowhere")).collect()
    assert len(gone) == 1 and gone[0].error


def test_clean_tree(spark, tmp_path):
    (tmp_path / "ok.py").write_text("x = 1  # fine\n")
    assert textfiles.scan_text_files(spark, str(tmp_path)).collect() == []


# ---- first wins, insert only ----------------------------------------------------------


def test_first_document_wins(creatives):
    df = creatives([
        dict(source_id="1", ad_text="late", ingested_at="2024-01-02"), dict(source_id="1", ad_text="first", ingested_at="2024-01-01"),
        dict(source_id="1", source="google", ad_text="other"), dict(source_id="1", ad_text="undated", ingested_at=None),
    ])
    assert sorted(r.ad_text for r in dedup.first_per_key(df).collect()) == ["first", "other"]


def test_one_key_with_a_third_of_all_rows(creatives):
    rng = random.Random(0)
    rows = [dict(source_id="hot" if i % 3 == 0 else str(rng.randint(0, 200)), ad_text=str(rng.random()), ingested_at=f"2024-01-{rng.randint(1, 28):02d}") for i in range(900)]
    df = creatives(rows).repartition(6)
    got = {r.source_id: (r.ingested_at, r.ad_text) for r in dedup.first_per_key(df).collect()}
    want = {}
    for r in rows:
        want[r["source_id"]] = min(want.get(r["source_id"], ("9",)), (r["ingested_at"], r["ad_text"]))
    assert got == want
    p = plan(dedup.first_per_key(df))
    assert p.rindex("WindowGroupLimit") > p.index("hashpartitioning(source_id")   # also below the shuffle


def test_counts(creatives):
    batch = creatives([dict(source_id=s) for s in ("1", "2", "2", "3")] + [dict(source_id=None)])
    target = creatives([dict(source_id="3"), dict(source_id="3"), dict(source_id="4")])
    assert tuple(dedup.upsert_counts(batch, target).first()) == (2, 0, 1)
    assert tuple(dedup.upsert_counts(batch.limit(0), target).first()) == (0, 0, 0)
    both = batch.unionAll(creatives([dict(brand="b", source_id="4")]))
    got = {r.brand: tuple(r)[1:] for r in dedup.upsert_counts(both, target, ["brand"]).collect()}
    assert got == {"acme": (2, 0, 1), "b": (0, 0, 0)}


def test_union_fills_missing_columns(creatives):
    a = creatives([dict(platform="p")])
    out = dedup.union_sources(a, a.drop("platform", "cta"))
    assert sorted(str(r.platform) for r in out.collect()) == ["None", "p"]
    assert out.columns == a.columns


# ---- tables ---------------------------------------------------------------------------


def spread(signals, n=60, **more):
    return signals([dict(brand=b, week_key=w, ad_count=i, **more) for b in ("a", "361") for i, w in enumerate(weeks(n))])


@pytest.mark.parametrize("by", ["year", "week"])
def test_replacing_a_week_leaves_the_others(spark, signals, by):
    path = shared_dir(spark, "t")
    tables.overwrite_weeks(spread(signals), path, by)
    new = signals([dict(brand="361", week_key=weeks(60)[10], ad_count=-1, channel="tv")])
    for _ in range(2):
        tables.overwrite_weeks(new, path, by)
        got = tables.read_table(spark, path, WEEKLY_SIGNALS, by)
        assert got.count() == 120
        assert [(r.week_key, r.channel) for r in got.filter("ad_count = -1").collect()] == [(weeks(60)[10], "tv")]
        assert got.filter("brand = '361'").count() == 60


def test_whole_table_modes(spark, signals):
    path = shared_dir(spark, "t")
    s = spread(signals, 5)
    for mode, n in (("append", 10), ("append", 20), ("overwrite", 10)):
        tables.overwrite_or_append(s, path, mode)
        assert tables.read_table(spark, path, s.schema).count() == n
    with pytest.raises(ValueError):
        tables.overwrite_or_append(s, path, "merge")


def test_reads_are_pruned(spark, signals):
    path = shared_dir(spark, "t")
    tables.append_rows(spread(signals), path)
    p = plan(tables.read_table(spark, path, WEEKLY_SIGNALS).filter("brand = 'a'").select("ad_count"))
    assert "PartitionFilters: [isnotnull(brand" in p
    assert "ReadSchema: struct<ad_count:bigint>" in p


def test_keyless_rows_are_rejected_every_time(spark, creatives):
    path = shared_dir(spark, "raw")
    batch = creatives([dict(source_id=s, week_key="2024-W02", ad_text=str(i)) for i, s in enumerate(["1", None, None, "", "2"])])
    assert [loads.insert_only(batch, path).count() for _ in range(3)] == [2, 0, 0]
    assert tables.read_table(spark, path, batch.schema).count() == 2
    assert tuple(dedup.upsert_counts(batch, batch.limit(0)).first()) == (2, 0, 3)
    bad = tables.rejects(creatives([dict(source_id=None), dict(brand=None), dict(week_key=None), dict()]))
    assert sorted(r.reason for r in bad.collect()) == ["brand", "key", "week"]


def test_replacing_reads_only_the_partitions_it_touches(spark, signals):
    path = shared_dir(spark, "t")
    s = spread(signals)
    tables.overwrite_weeks(s, path)
    some = tables.with_layout(signals([dict(brand="361", week_key="2025-W05")]))
    stored = spark.read.schema(tables.stored_schema(s.schema)).parquet(path)
    p = plan(tables.touched_weeks(stored, some))
    assert "361" in p[p.index("PartitionFilters"):].split("]")[0] and "2025" in p


def test_second_load_inserts_nothing(spark, creatives):
    path = shared_dir(spark, "raw")
    batch = creatives([dict(source_id=str(i % 7), week_key=w) for i, w in enumerate(weeks(20))])
    assert loads.insert_only(batch, path).count() == 7
    assert loads.insert_only(batch, path).count() == 0
    assert tables.read_table(spark, path, batch.schema).count() == 7


def test_create_table(spark, signals):
    path = shared_dir(spark, "catalog")
    tables.create_table(spark, "made_signals", WEEKLY_SIGNALS, path)
    assert set(spark.table("made_signals").columns) == set(WEEKLY_SIGNALS.names)
    tables.append_rows(spread(signals, 3), path, "week")
    spark.sql("ALTER TABLE made_signals RECOVER PARTITIONS")
    assert spark.table("made_signals").filter("brand = 'a'").count() == 3
    spark.sql("DROP TABLE made_signals")


# ---- snapshots ------------------------------------------------------------------------


def test_snapshots(spark, signals):
    root = shared_dir(spark, "snap")
    assert snapshots.list_snapshots(spark, root, "t").count() == 0
    s = spread(signals, 4, spend_midpoint=10.0)
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    old, new = s.filter("ad_count < 2"), s.filter("ad_count >= 2")
    assert [snapshots.commit(old, root, "overwrite", day[0]), snapshots.commit(new, root, "append", day[1])] == [1, 2]
    snapshots.commit(s.filter("brand = 'a'"), root, "overwrite", day[2])
    assert [snapshots.read_as_of(spark, root, i).count() for i in (1, 2, 3)] == [4, 8, 4]
    assert snapshots.read_as_of(spark, root).count() == 4
    assert snapshots.read_as_of(spark, root, 2, F.col("brand") == "a").count() == 4
    listed = snapshots.list_snapshots(spark, root, "t").collect()
    assert [(r.snapshot_id, r.operation, r.added_records) for r in listed] == [(3, "overwrite", 4), (2, "append", 4), (1, "overwrite", 4)]
    assert listed[0].committed_at == str(int(day[2].replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    assert snapshots.snapshot_at(spark, root, dt.datetime(2024, 1, 2, 12)) == 2
    with pytest.raises(ValueError):
        snapshots.read_as_of(spark, root, 9)
    # Rows of an interrupted commit have no log row: invisible, and replaced later.
    s.write.partitionBy("brand").parquet(f"{root}/data/snapshot_id=4")
    assert snapshots.read_as_of(spark, root).count() == 4
    assert snapshots.commit(new, root, "append", day[3]) == 4
    assert snapshots.read_as_of(spark, root).count() == 8


def test_brands_that_look_like_numbers_and_new_columns(spark, signals):
    root = shared_dir(spark, "snap")
    s = signals([dict(brand="007"), dict(brand="010")])
    snapshots.commit(s, root, "overwrite", dt.datetime(2024, 1, 1))
    assert sorted(r.brand for r in snapshots.read_as_of(spark, root).collect()) == ["007", "010"]
    snapshots.commit(s.withColumn("note", F.lit("n")), root, "append", dt.datetime(2024, 1, 2))
    assert sorted((r.brand, r.note) for r in snapshots.read_as_of(spark, root).filter("note is not null").collect()) == [("007", "n"), ("010", "n")]
    assert snapshots.read_as_of(spark, root).count() == 4


def test_a_replacement_stands_for_its_weeks(spark, signals):
    root = shared_dir(spark, "snap")
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    snapshots.commit(spread(signals, 4), root, "overwrite", day[0])
    new = signals([dict(brand="a", week_key=weeks(4)[1], channel=c, ad_count=-1) for c in ("tv", "web")])
    snapshots.commit(new, root, "replace", day[1])
    got = snapshots.read_as_of(spark, root)
    assert (got.count(), got.filter("ad_count = -1").count()) == (9, 2)
    # Stopped between the rows and the log: the old state is still there.
    spread(signals, 4).write.partitionBy("brand").parquet(f"{root}/data/snapshot_id=3")
    assert snapshots.read_as_of(spark, root).count() == 9
    assert snapshots.read_as_of(spark, root, 1).count() == 8
    snapshots.commit(signals([dict(brand="a", week_key=weeks(4)[1], ad_count=-2)]), root, "replace", day[2])
    assert sorted(r.ad_count for r in snapshots.read_as_of(spark, root).filter("ad_count < 0").collect()) == [-2]


def test_order_is_by_commit_time(spark, signals):
    root = shared_dir(spark, "snap")
    s = spread(signals, 1)
    snapshots.commit(s, root, "overwrite", dt.datetime(2024, 1, 2))
    snapshots.commit(s, root, "overwrite", dt.datetime(2024, 1, 1))
    assert [r.snapshot_id for r in snapshots.list_snapshots(spark, root, "t").collect()] == [1, 2]
    assert snapshots.snapshot_at(spark, root, dt.datetime(2024, 1, 3)) == 1


def test_diffs(signals):
    a = signals([dict(week_key="2024-W01", spend_midpoint=100.0), dict(week_key="2024-W02", spend_midpoint=5.0), dict(week_key="2024-W03", spend_midpoint=1.0)])
    b = signals([dict(week_key="2024-W01", spend_midpoint=150.0), dict(week_key="2024-W03", spend_midpoint=1.0), dict(week_key="2024-W04", spend_midpoint=2.0)])
    r = snapshots.snapshot_diff(a, b).first()
    assert (r.spend_prev, r.spend_cur, r.delta, round(r.pct, 2)) == (106.0, 153.0, 47.0, 44.34)
    empty = snapshots.snapshot_diff(a.limit(0), b).first()
    assert (empty.spend_prev, empty.delta) == (0.0, 153.0)
    states = {r.week_key: r.state for r in snapshots.snapshot_full_outer(a, b).collect()}
    assert states == {"2024-W01": "changed", "2024-W02": "removed", "2024-W03": "kept", "2024-W04": "added"}


def test_a_long_chain_is_written_anew(spark, signals, monkeypatch):
    monkeypatch.setattr(snapshots, "CHAIN", 3)
    root = shared_dir(spark, "snap")
    for day in range(1, 9):
        snapshots.commit(signals([dict(brand="a", week_key=weeks(8)[day % 3], ad_count=day)]), root, "replace", dt.datetime(2024, 1, day))
    assert sorted(r.ad_count for r in snapshots.read_as_of(spark, root).collect()) == [6, 7, 8]
    listed = snapshots.list_snapshots(spark, root, "t").collect()
    assert sum(r.operation == "compact" for r in listed) == 2
    assert snapshots._chain(spark, root, None).count() <= 4
    assert sorted(r.ad_count for r in snapshots.read_as_of(spark, root, 2).collect()) == [1, 2]


def test_expired_snapshots_go_and_kept_ones_stay_whole(spark, signals, tmp_path):
    root = str(tmp_path / "snap")
    day = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    s = spread(signals, 4)
    snapshots.commit(s, root, "overwrite", day[0])
    snapshots.commit(s.limit(1), root, "append", day[1])
    snapshots.commit(s.filter("brand = 'a'"), root, "overwrite", day[2])
    snapshots.commit(s.filter("brand <> 'a'"), root, "append", day[3])
    assert snapshots.expire(spark, root, dt.datetime(2023, 1, 1)) == []
    before = [snapshots.read_as_of(spark, root, i).count() for i in (3, 4)]
    assert snapshots.expire(spark, root, dt.datetime(2024, 1, 4, 12)) == [1, 2]
    assert [snapshots.read_as_of(spark, root, i).count() for i in (3, 4)] == before
    assert sorted(p.name for p in (tmp_path / "snap" / "data").iterdir()) == ["snapshot_id=3", "snapshot_id=4"]
    with pytest.raises(ValueError):
        snapshots.read_as_of(spark, root, 2)
    assert [r.snapshot_id for r in snapshots.list_snapshots(spark, root, "t").collect()] == [4, 3]
    assert snapshots.commit(s, root, "append", day[5]) == 5


def test_changes_equal_the_full_comparison_and_read_only_what_changed(spark, signals):
    root = shared_dir(spark, "snap")
    day = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    s = spread(signals, 6, spend_midpoint=5.0)
    snapshots.commit(s, root, "overwrite", day[0])
    snapshots.commit(signals([dict(brand="a", week_key=weeks(6)[1], channel="tv", spend_midpoint=9.0)]), root, "replace", day[1])
    snapshots.commit(signals([dict(brand="a", week_key="2025-W01", spend_midpoint=1.0)]), root, "append", day[2])

    def both(a, b):
        whole = snapshots.snapshot_full_outer(snapshots.read_as_of(spark, root, a), snapshots.read_as_of(spark, root, b))
        return sorted(map(str, whole.filter("state <> 'kept'").collect()))

    for a, b in ((1, 2), (2, 3), (1, 3), (3, 3)):
        assert sorted(map(str, snapshots.changes(spark, root, a, b).collect())) == both(a, b)
    p = plan(snapshots.changes(spark, root, 2, 3))
    assert p.count("=a") >= 2 and "snapshot_id" in p
    snapshots.commit(s.limit(2), root, "overwrite", day[3])
    assert sorted(map(str, snapshots.changes(spark, root, 2, 4).collect())) == both(2, 4)


# ---- documents that cannot be read -------------------------------------------------------


def test_unreadable_lines_are_kept_with_their_file(spark, tmp_path):
    good = json.dumps({"source_id": "1", "source": "meta", "brand": "b", "impression_lower": 5})
    lines = [good, good[:20], "", "not json", '"text"', '{"source_id": "2", "impression_lower": "many"}', '{"other": 1}', "{}"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text(good[:30] + "\n")
    rows, bad = docs.scan_documents(spark, str(tmp_path))
    assert rows.columns == RAW_CREATIVES.names
    assert sorted(str(r.source_id) for r in rows.collect()) == ["1", "2", "None", "None"]
    got = sorted((r.file.rsplit("/", 1)[1], r.text, r.reason) for r in bad.collect())
    assert got == sorted([
        ("a.json", good[:20], "document"), ("a.json", "not json", "document"), ("a.json", '"text"', "document"),
        ("a.json", lines[5], "value"), ("b.json", good[:30], "document"),
    ])
    texts = spark.createDataFrame([(x, 1) for x in lines if x], "j string, reason int").drop("reason")
    bad = docs.unreadable_documents(texts, "j")
    assert sorted((r.j, r.reason) for r in bad.collect()) == sorted((t, k) for f, t, k in got if f == "a.json")


# ---- the run --------------------------------------------------------------------------


def test_weekly_run_without_documents(spark, creatives):
    raw, facts = shared_dir(spark, "raw"), shared_dir(spark, "facts")
    nothing = creatives([dict()]).limit(0)
    assert weekly_run(nothing, raw, facts) == dict(docs_read=0, raw_rows=0, signal_rows=0)
    assert weekly_run(creatives([dict()]), raw, facts) == dict(docs_read=1, raw_rows=1, signal_rows=1)


def test_weekly_run_twice_then_more(spark, creatives):
    raw, facts = shared_dir(spark, "raw"), shared_dir(spark, "facts")
    rows = [dict(source_id=str(i % 30), week_key=weeks(6)[i % 6], spend_upper=10.0, ad_text="x\u200b", cta="Go") for i in range(60)]
    batch = creatives(rows)
    assert weekly_run(batch, raw, facts) == dict(docs_read=60, raw_rows=30, signal_rows=6)
    schema = weekly.weekly_signals(batch).schema
    before = sorted(map(str, tables.read_table(spark, facts, schema).collect()))
    assert weekly_run(batch, raw, facts) == dict(docs_read=60, raw_rows=0, signal_rows=6)
    assert sorted(map(str, tables.read_table(spark, facts, schema).collect())) == before
    assert weekly_run(creatives([dict(source_id="new", week_key=weeks(6)[2], spend_upper=90.0)]), raw, facts) == dict(
        docs_read=1, raw_rows=1, signal_rows=1)
    got = {r.week_key: (r.ad_count, r.spend_midpoint) for r in tables.read_table(spark, facts, schema).collect()}
    assert got == {w: (6, 70.0) if i == 2 else (5, 25.0) for i, w in enumerate(weeks(6))}
    assert {r.ad_text for r in spark.read.parquet(raw).select("ad_text").distinct().collect()} == {"x", None}


def test_run_reports_what_it_cannot_store_and_keeps_history(spark, creatives):
    raw, facts, bad, history = (shared_dir(spark, n) for n in ("raw", "facts", "bad", "history"))
    batch = creatives([
        dict(week_key=None, started_running="2024-01-10", spend_upper=1e300), dict(week_key=""), dict(source_id=None),
        dict(week_key="2024-W02", cta="\u200b"), dict(brand=None),
    ])
    got = weekly_run(batch, raw, facts, rejected=bad, snapshots=history, committed_at=dt.datetime(2024, 2, 1))
    assert got == dict(docs_read=5, raw_rows=2, signal_rows=1, rejected_rows=3)
    row = snapshots.read_as_of(spark, history).first()
    assert (row.week_key, row.ad_count, row.spend_upper_sum, row.top_ctas) == ("2024-W02", 2, 0.0, [])
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["brand", "key", "week"]


def test_run_cut_short_is_mended(spark, creatives, monkeypatch):
    import spendtide.plans.weekly_run as run

    raw, facts = shared_dir(spark, "raw"), shared_dir(spark, "facts")
    batch = creatives([dict(source_id=str(i), week_key=w) for i, w in enumerate(weeks(3))])

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(run, "overwrite_weeks", fail)
        with pytest.raises(RuntimeError):
            weekly_run(batch, raw, facts)
    assert weekly_run(batch, raw, facts) == dict(docs_read=3, raw_rows=0, signal_rows=3)
    assert tables.read_table(spark, facts, weekly.weekly_signals(batch).schema).count() == 3


# ---- inputs that grow -----------------------------------------------------------------


def test_texts_become_files_of_few_folders(spark):
    mark = "​"
    texts = [(i, f"a\nb{mark}{i}") for i in range(2000)] + [(7, f"{mark}c"), (2000, None)]
    path = shared_dir(spark, "tree")
    textfiles.write_texts(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), path, "doc_id", "text")
    assert len(os.listdir(path)) <= textfiles.FOLDERS
    got = sorted((int(r.file.split("doc_id=")[1].split("-")[0]), r.line, r.col) for r in textfiles.scan_all_text(spark, path).collect())
    assert got == sorted([(i, 2, 2) for i in range(2000)] + [(7, 3, 1)])


def test_batches_land_in_order_and_no_task_has_a_whole_one(spark):
    rows = staged(spark.range(0, 4000, 1, 4).withColumn("batch", F.when(F.col("id") < 5, 0).otherwise(1 + F.col("id") % 2)))
    path, files = catalog.land([rows.filter(F.col("batch") == k) for k in range(3)])
    names = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files > 1 and len(names) == 3 * files
    log = shared_dir(spark, "log")
    stream = feeds.landed(spark, path, rows.schema, files)
    feeds.to_changelog(stream, log, shared_dir(spark, "mark"), mode="append").awaitTermination()
    got = spark.read.parquet(log).filter("id is not null").groupBy("batch_id").agg(F.collect_set("batch").alias("b"), F.count("*").alias("n"))
    assert sorted((r.batch_id, r.b, r.n) for r in got.collect()) == [(0, [0], 5), (1, [1], 1997), (2, [2], 1998)]


def test_only_keys_of_new_rows_move(spark, creatives):
    batch = staged(creatives([dict(source_id=str(i % 50), ad_text=f"{i:02d}") for i in range(60)] + [dict(source_id=None)]))
    held = creatives([dict(source_id=str(i)) for i in (3, 30)]).select(*dedup.KEY)
    new = dedup.new_rows(batch, held)
    assert sorted(int(r.ad_text) for r in new.collect()) == [i for i in range(50) if i not in (3, 30)]
    once = dedup.new_rows(batch.filter("cast(ad_text as int) >= 10"), held)
    assert once.count() == 48 and "ad_text" not in "".join(x for x in plan(once).split("\n") if "Exchange" in x)
    assert dedup.new_rows(batch, batch.select(*dedup.KEY)).count() == 0


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_rows_of_many_keys_are_sieved(spark, creatives, monkeypatch, bits):
    """Few or most bits shared; whatever part of the keys is held; a held key listed twice."""
    monkeypatch.setattr(dedup, "SIEVED", 5)
    monkeypatch.setattr(dedup, "MOST_BITS", bits)
    monkeypatch.setattr(dedup, "PAGE", 1)
    rows = [dict(source_id=str(i % 90), ad_text=f"{i:03d}") for i in range(120)] + [dict(source_id=None), dict(source_id="")]
    batch = staged(creatives(rows))
    for held in ([], range(20, 23), range(25, 75), range(80), range(90)):
        known = creatives([dict(source_id=str(i)) for i in [*held, *held] or [999]]).select(*dedup.KEY)
        new = dedup.new_rows(batch, known)
        assert sorted(r.ad_text for r in new.collect()) == [f"{i:03d}" for i in range(90) if i not in held]


def test_rows_that_a_sieve_lets_pass_do_not_move(spark, creatives, monkeypatch):
    monkeypatch.setattr(dedup, "SIEVED", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = staged(creatives([dict(source_id=str(i % 90), ad_text=f"{i:03d}") for i in range(120)]))
        p = plan(dedup.new_rows(batch, creatives([dict(source_id="x")]).select(*dedup.KEY)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moves_of(p, "ad_text") == 0


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def gone(spark, before):
    """Whether files that are new since then go, without a garbage collection."""
    for _ in range(50):
        if shuffle_files(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_shuffle_files_go_with_the_step_that_made_them(spark, creatives):
    before, set_ = shuffle_files(spark), spark.conf.get(session.FREED, None)
    rows = staged(creatives([dict() for _ in range(20)]).repartition(3, "source_id"))
    assert gone(spark, before)
    stream = feeds.landed(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema).repartition(3, "source_id")
    before = shuffle_files(spark)
    feeds.upsert_to_tables(stream, *(shared_dir(spark, n) for n in ("raw", "facts", "mark"))).awaitTermination()
    assert gone(spark, before) and spark.conf.get(session.FREED, None) == set_


def test_dates_are_not_read_again_and_ascii_themes_not_taken_apart(spark, creatives):
    rows = creatives([dict(creative_themes=["a\u200b", None, "b"]), dict(creative_themes=["c", None]), dict(creative_themes=None)])
    typed = rows.withColumns({"started_running": F.lit("2024-01-01").cast("date"), "ingested_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    assert [r.creative_themes for r in clean.sanitize_texts(typed).orderBy("source_id").collect()] == [["a", None, "b"], ["c", None], None]
    cast = clean.cast_dates(typed).orderBy("source_id")
    assert cast.select("started_running", "ingested_at").collect() == typed.select("started_running", "ingested_at").collect()
    assert "cast(ingested_at" not in str(cast._jdf.queryExecution().analyzed()) and "cast(stopped_running" in str(cast._jdf.queryExecution().analyzed().toString())


def test_landings_are_packed(spark):
    for name in ("read_pages", "scan_all"):
        files = entry.queries()[name](spark, SF).inputFiles()
        assert files and all(f.endswith(".json.gz") for f in files)


def moves_of(text, column):
    """Exchanges above the scan that has the column."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and column in x)
    n = 0
    for i in range(at, -1, -1):
        if depth[i] < depth[at]:
            at, n = i, n + ("Exchange" in lines[i])
    return n


def test_lines_move_for_two_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, pages = plan(starschema.creatives(spark, SF)), plan(catalog.ad_pages(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moves_of(lines, "l_partkey") == 2 and moves_of(pages, "l_partkey") == 1
    assert "from_json" not in pages
