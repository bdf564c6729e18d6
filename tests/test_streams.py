"""Streams over several arrivals, replays and reruns, against their batch results."""

import uuid

from pyspark.sql import functions as F

from conftest import SF, weeks
from spendtide import session
from spendtide.operators import weekly
from spendtide.plans import starschema
from spendtide.session import shared_dir
from spendtide.sources import tables
from spendtide.streaming import feeds


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_new_documents_are_counted_once(spark, creatives):
    inbox, log, mark = (shared_dir(spark, n) for n in ("inbox", "log", "mark"))
    df = creatives([dict() for _ in range(5)])
    for n in (5, 3):
        land(df.limit(n), inbox)
        for _ in range(2):
            feeds.new_docs_since(feeds.landed(spark, inbox, df.schema), log, mark).awaitTermination()
    assert sorted(r.new_docs for r in spark.read.parquet(log).collect()) == [3, 5]


COLS = [
    *weekly.GRAIN, "ad_count", "active_ad_count", "impression_lower_sum", "impression_upper_sum", "spend_lower_sum",
    "spend_upper_sum", "spend_midpoint",
]


def rows_of(df):
    return sorted(map(str, df.select(*COLS).collect()))


def test_weekly_windows_over_three_arrivals(spark):
    c = starschema.creatives(spark, SF)
    inbox, log, mark = (shared_dir(spark, n) for n in ("inbox", "windows", "mark"))
    for k in range(3):
        land(c.filter(F.pmod(F.xxhash64("source_id"), F.lit(3)) == k), inbox)
        stream = feeds.stream_weekly_signals(feeds.landed(spark, inbox, c.schema), F.col("started_running"), "4000 days")
        feeds.to_changelog(stream, log, mark).awaitTermination()
    got = feeds.latest(spark, log, weekly.GRAIN)
    assert rows_of(got) == rows_of(weekly.weekly_measures(c))
    assert got.filter(F.dayofweek("monday") != 2).count() == 0


def test_no_window_closes_on_late_rows(spark):
    """Newest weeks first, a micro-batch per file, then the same checkpoint again, then a gap in the regions."""
    c = starschema.creatives(spark, SF)
    c = c.withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    inbox, sums, mark = (shared_dir(spark, n) for n in ("inbox", "sums", "mark"))
    for low, high in (("1996", "9"), ("1994", "1996"), ("0", "1994")):
        land(c.filter((F.col("week_key") >= low) & (F.col("week_key") < high)), inbox)
    for _ in range(2):
        feeds.count_weeks(feeds.landed(spark, inbox, c.schema, 1), F.col("started_running"), sums, mark).awaitTermination()
    assert rows_of(feeds.weekly_windows(spark, sums)) == rows_of(weekly.weekly_measures(c))
    assert spark.read.parquet(sums).select("batch_id").distinct().count() > 1


def test_distinct_rows_pass_however_late(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, out, mark = (shared_dir(spark, n) for n in ("inbox", "out", "mark"))
    day = F.dayofmonth("ts")
    for part in (day > 20, day <= 5, (day > 3) & (day <= 20)):
        land(ev.filter(part), inbox)
    feeds.to_changelog(feeds.stream_dedup(feeds.landed(spark, inbox, ev.schema, 1), keys=["event_id"]), out, mark, "append").awaitTermination()
    got = spark.read.parquet(out)
    assert (got.count(), got.select("event_id").distinct().count()) == (ev.count(), ev.count())


def test_replayed_slice_is_dropped(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, out, mark = (shared_dir(spark, n) for n in ("inbox", "out", "mark"))
    land(ev, inbox)
    land(ev.limit(100), inbox)
    stream = feeds.landed(spark, inbox, ev.schema)
    feeds.to_changelog(feeds.stream_dedup(stream, "ts", keys=["event_id"]), out, mark, "append").awaitTermination()
    land(ev.filter("event_id < 50"), inbox)
    stream = feeds.landed(spark, inbox, ev.schema)
    feeds.to_changelog(feeds.stream_dedup(stream, "ts", keys=["event_id"]), out, mark, "append").awaitTermination()
    got = spark.read.parquet(out)
    assert (got.count(), got.select("event_id").distinct().count()) == (ev.count(), ev.count())


def test_upsert_sink(spark, creatives):
    inbox, raw, facts, mark = (shared_dir(spark, n) for n in ("inbox", "raw", "facts", "mark"))
    first = creatives([dict(source_id=str(i), week_key=weeks(8)[i % 8], spend_upper=10.0) for i in range(40)])
    more = creatives([dict(source_id=str(i), week_key=weeks(8)[i % 8], spend_upper=10.0) for i in range(30, 48)])

    def run(checkpoint):
        feeds.upsert_to_tables(feeds.landed(spark, inbox, first.schema, 1), raw, facts, checkpoint).awaitTermination()
        schema = weekly.weekly_signals(first).schema
        return sorted(map(str, tables.read_table(spark, facts, schema).collect()))

    land(first, inbox)
    run(mark)
    land(more, inbox)
    land(first.limit(5), inbox)
    got = run(mark)
    want = creatives([dict(source_id=str(i), week_key=weeks(8)[i % 8], spend_upper=10.0) for i in range(48)])
    assert got == sorted(map(str, weekly.weekly_signals(want).select(*tables.read_table(spark, facts, weekly.weekly_signals(want).schema).columns).collect()))
    assert spark.read.parquet(raw).count() == 48
    # A batch that runs again (here: a lost checkpoint starts over) changes nothing.
    assert run(shared_dir(spark, "mark2")) == got


def test_two_feeds_share_a_table(spark, creatives):
    """Batch ids of both start at 0; neither feed takes away what the other stored."""
    raw, facts, bad = (shared_dir(spark, n) for n in ("raw", "facts", "bad"))
    schema = None
    for source in ("meta", "google"):
        df = creatives([dict(source_id=str(i), source=source, cta="Go\u200b", spend_upper=10.0) for i in range(6)] + [dict(source_id=None, source=source)])
        inbox = shared_dir(spark, "inbox")
        land(df, inbox)
        feeds.upsert_to_tables(feeds.landed(spark, inbox, df.schema, 1), raw, facts, shared_dir(spark, "mark"), bad).awaitTermination()
        schema = weekly.weekly_signals(df).schema
    stored = spark.read.parquet(raw)
    assert {r.source: r["count"] for r in stored.groupBy("source").count().collect()} == {"meta": 6, "google": 6}
    row = tables.read_table(spark, facts, schema).collect()
    assert [(r.ad_count, r.spend_midpoint, r.top_ctas) for r in row] == [(12, 60.0, ["Go"])]
    assert spark.read.parquet(bad).count() == 2


def test_a_batch_leaves_no_intermediate_tables(spark, creatives, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _, name: str(tmp_path / "shared" / f"{name}-{uuid.uuid4().hex}"))
    inbox, raw, facts, mark = (str(tmp_path / n) for n in ("inbox", "raw", "facts", "mark"))
    df = creatives([dict(source_id=str(i)) for i in range(5)])
    for _ in range(2):
        land(df, inbox)
        feeds.upsert_to_tables(feeds.landed(spark, inbox, df.schema), raw, facts, mark).awaitTermination()
    assert [p.name for p in (tmp_path / "shared").iterdir()] == []


def test_a_watermark_bounds_the_state_of_dedup(spark):
    """Ten days in ten batches, each key twice: the state holds the keys of two delays and a batch, not all."""
    inbox, out, mark = (shared_dir(spark, n) for n in ("inbox", "out", "mark"))
    for day in range(1, 11):
        rows = spark.range(100).selectExpr(f"id + {day * 100} AS k", f"timestamp'2024-01-{day:02d} 12:00:00' AS ts")
        land(rows.unionAll(rows), inbox)
    stream = feeds.landed(spark, inbox, rows.schema, 1)
    query = feeds.to_changelog(feeds.stream_dedup(stream, "ts", "2 days", ["k"]), out, mark, "append")
    query.awaitTermination()
    got = spark.read.parquet(out)
    assert (got.count(), got.select("k").distinct().count()) == (1000, 1000)
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) <= 500 and "rocksdb" in str(query.lastProgress).lower()
    # A copy within the delay is dropped, one past it passes again, a row behind the watermark is lost.
    late = spark.createDataFrame([(1001, "2024-01-10 13:00:00"), (105, "2024-01-10 14:00:00"), (5000, "2024-01-03 00:00:00")], "k bigint, t string")
    land(late.selectExpr("k", "cast(t AS timestamp) AS ts"), inbox)
    feeds.to_changelog(feeds.stream_dedup(feeds.landed(spark, inbox, rows.schema, 1), "ts", "2 days", ["k"]), out, mark, "append").awaitTermination()
    again = spark.read.parquet(out).groupBy("k").count().filter("count > 1 or k = 5000").collect()
    assert [(r.k, r["count"]) for r in again] == [(105, 2)]


def test_spark_forgets_windows_behind_the_watermark(spark, creatives):
    inbox, log, mark = (shared_dir(spark, n) for n in ("inbox", "log", "mark"))
    for w in range(8):
        land(creatives([dict(source_id=str(w), started_running=f"2024-0{1 + w // 4}-{1 + 7 * (w % 4):02d}")]).withColumn("started_running", F.to_date("started_running")), inbox)
    schema = spark.read.parquet(inbox).schema
    stream = feeds.stream_weekly_signals(feeds.landed(spark, inbox, schema, 1), F.col("started_running"), "7 days")
    query = feeds.to_changelog(stream, log, mark, "append")
    query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 4
    assert 0 < spark.read.parquet(log).count() < 8


def test_closed_weeks_do_not_change_and_late_rows_are_counted(spark, creatives, monkeypatch):
    path, inbox, mark = (shared_dir(spark, n) for n in ("weeks", "inbox", "mark"))
    def ad(i, day):
        return dict(source_id=str(i), started_running=day, spend_upper=4.0)

    def step(*rows):
        land(creatives(list(rows)).withColumn("started_running", F.to_date("started_running")), inbox)
        schema = spark.read.parquet(inbox).schema
        feeds.close_weeks(feeds.landed(spark, inbox, schema, 1), F.col("started_running"), 7, path, mark).awaitTermination()
        return {str(r.monday): (r.ad_count, r.late_ads, r.closed) for r in feeds.corrected_weeks(spark, path).collect()}

    assert step(ad(0, None)) == {"None": (1, 1, False)}
    assert step(ad(1, "2024-01-01"), ad(2, "2024-01-09")) == {"2024-01-01": (1, 0, False), "2024-01-08": (1, 0, False), "None": (1, 1, False)}
    assert step(ad(4, "2024-01-02"), ad(5, "2024-01-16")) == {"2024-01-01": (2, 0, True), "2024-01-08": (1, 0, False), "2024-01-15": (1, 0, False), "None": (1, 1, False)}
    closed = sorted(map(str, spark.read.parquet(f"{path}/closed").collect()))
    got = step(ad(6, "2024-01-03"), ad(7, "2024-01-09"))
    assert got["2024-01-01"] == (3, 1, True) and got["2024-01-08"] == (2, 0, False)
    assert sorted(map(str, spark.read.parquet(f"{path}/closed").collect())) == closed
    feed = feeds.feed_id(spark, mark)
    assert sorted(w for (w,) in session.children(spark, f"{path}/open/feed={feed}", "week=*")) == ["week=2024-01-08", "week=2024-01-15"]

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # a batch that dies after it has written its sums, and runs again
        m.setattr(feeds, "_summed", fail)
        try:
            step(ad(8, "2024-03-01"))
        except Exception:
            pass
    got = step(ad(9, "2024-01-03"))
    assert got["2024-01-01"] == (4, 2, True) and got["2024-02-26"] == (1, 0, False) and got["2024-01-15"] == (1, 0, True)
    assert sum(v[0] for v in got.values()) == 9
