"""One raw table for runs and streams: index, partial aggregates, crashes at every step."""

import datetime as dt

import pytest
from conftest import SF, plan, weeks
from pyspark.sql import functions as F

from spendtide.operators import dedup, weekly
from spendtide.plans import starschema
from spendtide.plans.weekly_run import weekly_run
from spendtide.session import shared_dir, staged
from spendtide.sources import loads, snapshots, tables
from spendtide.streaming import feeds


def paths(spark):
    return [shared_dir(spark, n) for n in ("raw", "facts")]


def facts_in(spark, path, like):
    schema = weekly.weekly_signals(like).schema
    return sorted(map(str, tables.read_table(spark, path, schema).collect()))


def rebuilt(like, spark):
    schema = weekly.weekly_signals(like).schema
    return sorted(map(str, weekly.weekly_signals(like).select(*schema.names).collect()))


def stream(spark, df, raw, facts, mark=None):
    inbox = shared_dir(spark, "inbox")
    df.coalesce(1).write.parquet(inbox)
    feeds.upsert_to_tables(feeds.landed(spark, inbox, df.schema, 1), raw, facts, mark or shared_dir(spark, "mark")).awaitTermination()


def ads(creatives, ids, **more):
    return creatives([dict(source_id=str(i), week_key=weeks(6)[i % 6], spend_upper=10.0 + i, cta=f"c{i % 4}", creative_themes=[f"t{i % 7}", "all"], **more) for i in ids])


@pytest.mark.parametrize("order", ["run first", "stream first"])
def test_runs_and_streams_share_a_table(spark, creatives, order):
    raw, facts = paths(spark)
    steps = [lambda: weekly_run(ads(creatives, range(0, 30)), raw, facts), lambda: stream(spark, ads(creatives, range(20, 50)), raw, facts)]
    for step in steps if order == "run first" else reversed(steps):
        step()
    assert weekly_run(ads(creatives, range(45, 60)), raw, facts)["raw_rows"] == 10
    assert facts_in(spark, facts, ads(creatives, [0])) == rebuilt(ads(creatives, range(60)), spark)
    assert loads.read_loads(spark, raw, ads(creatives, [0]).schema).count() == 60
    assert loads.doubled_keys(spark, raw).count() == 0 and loads.unfinished(spark, raw) == set()


def test_facts_after_five_loads_equal_the_full_rebuild(spark):
    raw, facts = paths(spark)
    c = staged(dedup.first_per_key(starschema.creatives(spark, SF)))
    for k in range(5):
        weekly_run(c.filter(F.pmod(F.xxhash64("source_id"), F.lit(5)) <= k), raw, facts)
    schema = weekly.weekly_signals(c).schema
    rounded = [F.round(x, 4).alias(x) if t == "double" else F.col(x) for x, t in weekly.weekly_signals(c).dtypes]
    got = tables.read_table(spark, facts, schema).select(*rounded)
    assert sorted(map(str, got.collect())) == sorted(map(str, weekly.weekly_signals(c).select(*rounded).collect()))


def test_facts_are_made_without_raw_rows(spark, creatives):
    raw, facts = paths(spark)
    weekly_run(ads(creatives, range(30)), raw, facts)
    some = staged(tables.with_layout(ads(creatives, [1])).select("brand", "yr", "week_key"))
    p = plan(loads.facts_of(spark, raw, some))
    assert "_partials" in p and f"{raw}]" not in p and f"{raw}/" not in p
    assert "=acme" in p[p.index("PartitionFilters"):].split("]")[0]


def test_a_small_batch_reads_only_its_buckets(spark, creatives):
    raw, facts = paths(spark)
    weekly_run(ads(creatives, range(300)), raw, facts)
    batch = staged(ads(creatives, [5, 6]))
    own = loads.buckets_in(batch)
    assert 1 <= len(own) <= 2
    known = loads.stored_keys(spark, raw, ["source_id", "source"], own)
    p = plan(known)
    filters = p[p.index("PartitionFilters"):].split("ReadSchema")[0]
    assert "bucket" in filters and all(str(b) in filters for b in own)
    read = known.select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in read} == set(own)
    assert known.count() < 60 and known.join(batch, ["source_id", "source"]).count() == 2


@pytest.mark.parametrize("step", ["_index", "facts_of", "finish"])
def test_a_load_cut_short_is_finished_by_the_next_of_another_feed(spark, creatives, monkeypatch, step):
    raw, facts = paths(spark)
    weekly_run(ads(creatives, range(5)), raw, facts)

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(loads, step, fail)
        with pytest.raises(RuntimeError):
            weekly_run(ads(creatives, range(20)), raw, facts)
    assert len(loads.unfinished(spark, raw)) == 1
    # Another feed, other documents, weeks that the lost load touched and this one does not.
    stream(spark, ads(creatives, [0, 100]), raw, facts)
    assert facts_in(spark, facts, ads(creatives, [0])) == rebuilt(ads(creatives, [*range(20), 100]), spark)
    assert loads.unfinished(spark, raw) == set() and loads.doubled_keys(spark, raw).count() == 0


def test_a_stream_batch_that_runs_again_replaces_its_load(spark, creatives, monkeypatch):
    raw, facts = paths(spark)
    mark, inbox = shared_dir(spark, "mark"), shared_dir(spark, "inbox")
    df = ads(creatives, range(12))
    df.coalesce(1).write.parquet(inbox)

    def run():
        feeds.upsert_to_tables(feeds.landed(spark, inbox, df.schema, 1), raw, facts, mark).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(loads, "finish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    assert facts_in(spark, facts, df) == rebuilt(df, spark)
    assert len(loads.loads_of(spark, raw)) == 1 and loads.read_loads(spark, raw, df.schema).count() == 12


def test_rows_of_a_write_that_died_are_not_seen(spark, creatives):
    raw, facts = paths(spark)
    weekly_run(ads(creatives, range(3)), raw, facts)
    tables.with_layout(ads(creatives, range(50, 60))).write.partitionBy("brand", "yr").parquet(f"{raw}/_writing-dead")
    assert loads.read_loads(spark, raw, ads(creatives, [0]).schema).count() == 3
    assert weekly_run(ads(creatives, range(50, 52)), raw, facts)["raw_rows"] == 2


def test_equal_runs_leave_one_commit(spark, creatives):
    raw, facts = paths(spark)
    history = shared_dir(spark, "history")
    for day in (1, 2, 3):
        weekly_run(ads(creatives, range(10)), raw, facts, snapshots=history, committed_at=dt.datetime(2024, 1, day))
    assert snapshots.list_snapshots(spark, history, "t").count() == 1
    weekly_run(ads(creatives, [1, 200]), raw, facts, snapshots=history, committed_at=dt.datetime(2024, 1, 4))
    got = snapshots.read_as_of(spark, history)
    assert snapshots.list_snapshots(spark, history, "t").count() == 2
    assert sorted((r.week_key, r.ad_count) for r in got.select("week_key", "ad_count").collect()) == sorted(
        (r.week_key, r.ad_count) for r in tables.read_table(spark, facts, got.schema).collect())


def test_many_partitions_are_joined_not_listed(spark, signals, monkeypatch):
    s = signals([dict(brand=f"b{i}", week_key="2024-W02") for i in range(6)] + [dict(brand=None, week_key="2024-W02")])
    path = shared_dir(spark, "t")
    tables.append_rows(s, path)
    stored = spark.read.schema(tables.stored_schema(s.schema)).parquet(path)
    wanted = staged(tables.with_layout(s.filter("brand in ('b1', 'b2') or brand is null")))
    few = tables.only_partitions(stored, wanted, ["brand", "yr"])
    assert sorted(str(r.brand) for r in few.collect()) == ["None", "b1", "b2"]
    monkeypatch.setattr(tables, "MOST_PARTITIONS", 1)
    many = tables.only_partitions(stored, wanted.filter("brand is not null"), ["brand", "yr"])
    assert sorted(r.brand for r in many.collect()) == ["b1", "b2"] and "LeftSemi" in plan(many)
    assert tables.only_partitions(stored, wanted.limit(0), ["brand", "yr"]).count() == 0


def test_merged_partials_give_the_same_facts_and_new_loads_add_to_them(spark, creatives, monkeypatch):
    raw, facts = paths(spark)
    for k in range(3):
        weekly_run(ads(creatives, range(10 * k, 10 * k + 10)), raw, facts)
    stream(spark, ads(creatives, range(30, 35)), raw, facts)
    weeks_ = staged(loads.partial_rows(spark, raw).select("brand", "yr", "week_key").distinct())
    before = sorted(map(str, loads.facts_of(spark, raw, weeks_).collect()))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # dies with the sums written, before they count
        m.setattr(loads, "touch", lost)
        with pytest.raises(RuntimeError):
            loads.merge_partials(spark, raw)
    assert sorted(map(str, loads.facts_of(spark, raw, weeks_).collect())) == before
    assert loads.merge_partials(spark, raw) == 3  # the stream's newest batch stays apart
    assert sorted(map(str, loads.facts_of(spark, raw, weeks_).collect())) == before
    assert len(loads.loads_of(spark, loads._partials(spark, raw))) == 2
    weekly_run(ads(creatives, range(33, 40)), raw, facts)
    assert facts_in(spark, facts, ads(creatives, [0])) == rebuilt(ads(creatives, range(40)), spark)
    assert loads.merge_partials(spark, raw) == 2 and loads.merge_partials(spark, raw) == 0
