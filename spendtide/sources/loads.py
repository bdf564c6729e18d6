"""Loads into one raw table, by runs and streams alike, with an index of stored keys and partial aggregates.

    raw/feed=F/batch_id=N/brand=B/yr=Y/...        rows of a load; a load appears whole, by one rename
    raw_keys/bucket=K/feed=F/batch_id=N/...       its keys, by bucket of their hash
    raw_partials/gen=G/feed=F/batch_id=N/brand=B/yr=Y/  its partial aggregates (`weekly.partial_signals`)
    raw_done/feed=F/batch_id=N                    an empty file, written last

A load asks the index, not the table, which keys are stored: it reads the buckets that its own keys fall into.
Facts of a week are the sum of its partial aggregates, so no raw row is read again. What a crash leaves
between the first of these steps and the last is told by the missing mark; the next load, of whatever feed, does
the rest. `merge_partials` adds up those of many loads, as maintenance. Loads into one table run one after the other: two at once may store one key twice (`doubled_keys` finds those).
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtide.operators.dedup import KEY, complete, new_rows
from spendtide.operators.weekly import added_up, merged_signals, partial_signals
from spendtide.session import PACKED, Stages, children, path_exists, remove, rename, touch
from spendtide.sources.tables import LAYOUTS, only_partitions, stored_schema, with_layout

#: Buckets of the key index. A table keeps the number that it was made with.
BUCKETS = 64

LOAD = ["feed", "batch_id"]
#: Names of runs begin so; the feed of merged partial aggregates.
RUN, MERGED = "run-", "merged"
Load = tuple[str, int]


def home(path: str, feed: str, batch_id: int) -> str:
    return f"{path}/feed={feed}/batch_id={batch_id}"


def _with_load(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields)).add("feed", T.StringType()).add("batch_id", T.LongType())


def bucket_of(keys: list[str] = KEY) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(BUCKETS)).cast("int")


def _publish(df: DataFrame, path: str, at: str, by: list[str]) -> None:
    """Rows below the hidden name first, then all at once in their place."""
    spark, hidden = df.sparkSession, f"{path}/_writing-{uuid.uuid4().hex}"
    df.hint("rebalance", *[F.col(c) for c in by]).write.option("compression", PACKED).partitionBy(*by).parquet(hidden)
    remove(spark, at)
    rename(spark, hidden, at)


def loads_of(spark: SparkSession, path: str) -> set[Load]:
    """(feed, batch_id) of every load with a folder or mark in `path`."""
    return {(f.removeprefix("feed="), int(b.removeprefix("batch_id="))) for f, b in children(spark, path, "feed=*", "batch_id=*")}


def unfinished(spark: SparkSession, raw: str) -> set[Load]:
    return loads_of(spark, raw) - loads_of(spark, f"{raw}_done")


def _read(spark: SparkSession, path: str, schema: T.StructType, loads: set[Load] | None) -> DataFrame:
    """Rows below `path`; of some loads, whose folders alone are listed, or of all."""
    full = _with_load(schema)
    there = loads_of(spark, path) & loads if loads is not None else path_exists(spark, path)
    if not there:
        return spark.createDataFrame([], full)
    at = [path] if loads is None else [home(path, *load) for load in sorted(there)]
    return spark.read.schema(full).option("basePath", path).parquet(*at)


def read_loads(spark: SparkSession, raw: str, schema: T.StructType, loads: set[Load] | None = None) -> DataFrame:
    """Stored rows of all loads, or of some, with feed and batch_id behind."""
    return _read(spark, raw, stored_schema(schema), loads)


def stored_keys(spark: SparkSession, raw: str, keys: list[str], buckets: list[int], but: Load | None = None) -> DataFrame:
    """Keys that the table holds in these buckets, from the index; `but` leaves out a load that is being run again."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys]).add("bucket", T.IntegerType())
    path = f"{raw}_keys"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).select(*keys)
    rows = spark.read.schema(_with_load(schema)).parquet(path)
    rows = rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return (rows if but is None else rows.filter((F.col("feed") != but[0]) | (F.col("batch_id") != but[1]))).select(*keys)


def doubled_keys(spark: SparkSession, raw: str, keys: list[str] = KEY) -> DataFrame:
    """Keys that more than one load has stored, which only loads that ran at the same time can do."""
    found = stored_keys(spark, raw, keys, list(range(BUCKETS)))
    return found.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _index(rows: DataFrame, raw: str, keys: list[str], partials: bool) -> None:
    """Keys and partial aggregates of written loads. Running it again replaces what it wrote."""
    by = ["bucket", *LOAD]
    index = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], bucket_of(keys).alias("bucket"), *LOAD)
    index.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{raw}_keys")
    if partials:
        by = [*LOAD, *LAYOUTS["year"]]
        sums = with_layout(partial_signals(rows, LOAD))
        sums.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(_partials(rows.sparkSession, raw))


def store(batch: DataFrame, raw: str, load: Load, buckets: list[int], keys: list[str] = KEY, partials: bool = True) -> set[Load]:
    """Store the rows of `batch` (a written table) whose key is new, first per key, as the load `load`.

    Returns the loads whose weeks are to be refreshed: this one, and any that a crash has left unfinished; `finish` marks
    them. `buckets` are those of the batch's complete keys. A load that is run again ignores and replaces what its own first
    run stored.
    """
    spark = batch.sparkSession
    remove(spark, home(f"{raw}_done", *load))
    left = unfinished(spark, raw) - {load}
    if left:
        _index(read_loads(spark, raw, batch.schema, left), raw, keys, partials)
    known = stored_keys(spark, raw, keys, buckets, but=load)
    with Stages(spark) as stages:
        added = new_rows(batch, known, keys, stages)
        _publish(with_layout(added), raw, home(raw, *load), LAYOUTS["year"])
    _index(read_loads(spark, raw, batch.schema, {load}), raw, keys, partials)
    return left | {load}


def partial_rows(spark: SparkSession, raw: str, loads: set[Load] | None = None) -> DataFrame:
    """Partial aggregates of all loads, or of some."""
    return _read(spark, _partials(spark, raw), PARTIALS, loads)


def _partials(spark: SparkSession, raw: str) -> str:
    """The folder of the newest generation: the highest that is marked, or the first."""
    marked = [int(g.removeprefix("gen=")) for g, _ in children(spark, f"{raw}_partials", "gen=*", "_current")]
    return f"{raw}_partials/gen={max(marked, default=0)}"


def merge_partials(spark: SparkSession, raw: str) -> int:
    """Add the partial aggregates of finished loads together; returns how many loads that were.

    They grow with the loads, the sums do not. A stream's newest batch stays apart, as it may be run again; runs never are. The
    sums are a new generation of the folder, which counts from the moment of its mark; then the old one goes. A crash before
    the mark leaves the old one in force, one after it an old folder that nobody reads.
    """
    loads_now = loads_of(spark, old := _partials(spark, raw))
    newest = {f: max(b for g, b in loads_now if g == f) for f, _ in loads_now}
    done = loads_of(spark, f"{raw}_done")
    apart = {(f, b) for f, b in loads_now if f != MERGED and ((f, b) not in done or b == newest[f] and not f.startswith(RUN))}
    merging = loads_now - apart
    if len(merging) < 2:
        return 0
    number = int(old.rsplit("=", 1)[1]) + 1
    new = f"{raw}_partials/gen={number}"
    remove(spark, new)
    kept = _read(spark, old, PARTIALS, apart).unionByName(
        added_up(_read(spark, old, PARTIALS, merging)).withColumns({"feed": F.lit(MERGED), "batch_id": F.lit(number).cast("bigint")})
    )
    by = [*LOAD, *LAYOUTS["year"]]
    kept.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by).parquet(new)
    touch(spark, f"{new}/_current")
    remove(spark, old)
    return len(merging)


def facts_of(spark: SparkSession, raw: str, weeks: DataFrame, batch_ts: Column | None = None) -> DataFrame:
    """Fact rows of the (brand, yr, week_key) groups in `weeks`, a written table: their partial aggregates of all loads, added up.

    Only the brand-years that `weeks` names are read, and no raw row.
    """
    keys = ["brand", "yr", "week_key"]
    some = only_partitions(partial_rows(spark, raw), weeks, LAYOUTS["year"])
    return merged_signals(some.join(weeks.select(*keys).distinct(), keys, "left_semi"), batch_ts)


def finish(spark: SparkSession, raw: str, loads: set[Load]) -> None:
    for load in loads:
        touch(spark, home(f"{raw}_done", *load))


def insert_only(
    df: DataFrame, raw: str, load: Load | None = None, keys: list[str] = KEY, stages: Stages | None = None, written: bool = False
) -> DataFrame:
    """Add the rows whose key the table lacks, first per key; returns them, as written. A `written` table is not written again.

    A second load of the same rows adds nothing. A row without its whole key cannot be recognised when it comes
    again, so it is not stored: see `tables.rejects`.
    """
    spark = df.sparkSession
    load = load or run_load()
    with Stages(spark) as own:
        batch = df if written else (stages or own).write(df, "batch")
        finish(spark, raw, store(batch, raw, load, buckets_in(batch, keys), keys, partials=False))
    return read_loads(spark, raw, df.schema, {load}).select(*df.columns)


def buckets_in(batch: DataFrame, keys: list[str] = KEY) -> list[int]:
    """At most BUCKETS numbers."""
    return sorted(batch.filter(complete(keys)).agg(F.collect_set(bucket_of(keys))).first()[0])


def run_load() -> Load:
    """The name of a run's load; no other has it."""
    return f"{RUN}{uuid.uuid4().hex}", 0


PARTIALS = T.StructType([
    T.StructField("brand", T.StringType()), T.StructField("week_key", T.StringType()), T.StructField("channel", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("ad_count", T.LongType()), T.StructField("active_ad_count", T.LongType()),
    T.StructField("impression_lower_sum", T.LongType()), T.StructField("impression_upper_sum", T.LongType()),
    T.StructField("spend_lower_sum", T.DecimalType(38, 0)), T.StructField("spend_upper_sum", T.DecimalType(38, 0)),
    T.StructField("yr", T.StringType()),
])
