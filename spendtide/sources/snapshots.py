"""Snapshots of a table on plain Parquet.

    root/data/snapshot_id=N/...   rows of commit N
    root/log/...                  one row per commit, with the table's columns

A commit writes its rows, then its log row, so readers, who take only logged ids,
never see half a commit. An append adds to the chain; an overwrite starts a new
one; a replace stands for all earlier rows of the (brand, week) groups it holds. A chain of more than CHAIN commits is
written anew as one commit of the same rows (`compact`), so no reader meets a longer one. `expire` deletes what no kept
snapshot needs. One writer at a time is assumed.
"""

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtide.functions.numbers import amount, exact, pct_change
from spendtide.session import children, path_exists, remove, staged
from spendtide.sources.tables import only_partitions

LOG = "snapshot_id bigint, parent_id bigint, committed_at timestamp, operation string, added_records bigint, columns string"
OPERATIONS = ("append", "overwrite", "replace", "compact")
#: Operations that hold the whole table.
WHOLE = ["overwrite", "compact"]
#: Commits that a reader goes through at most.
CHAIN = 20
EXPIRED = "below bigint"
GROUP = ["brand", "week_key"]


def snapshot_log(spark: SparkSession, root: str) -> DataFrame:
    """All commits. Empty before the first one."""
    if path_exists(spark, f"{root}/log"):
        return spark.read.schema(LOG).parquet(f"{root}/log").filter(F.col("snapshot_id") >= _below(spark, root))
    return spark.createDataFrame([], LOG)


def _below(spark: SparkSession, root: str) -> int:
    """Snapshots with smaller ids have expired."""
    if not path_exists(spark, f"{root}/expired"):
        return 0
    return spark.read.schema(EXPIRED).parquet(f"{root}/expired").agg(F.coalesce(F.max("below"), F.lit(0))).first()[0]


def commit(df: DataFrame, root: str, operation: str, committed_at: datetime, by: tuple[str, ...] = ("brand",)) -> int:
    """Store `df` as the next snapshot and return its id."""
    if operation not in OPERATIONS:
        raise ValueError(f"operation must be one of {OPERATIONS}")
    spark = df.sparkSession
    last = snapshot_log(spark, root).agg(F.max("snapshot_id")).first()[0]
    new = (last or 0) + 1
    path = f"{root}/data/snapshot_id={new}"
    # An unlogged folder of an interrupted commit is replaced.
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)
    # Counted from the files' footers; a metric observed while writing would count redone tasks twice.
    added = spark.read.schema(df.schema).parquet(path).count()
    row = (new, last, committed_at, operation, added, df.schema.json())
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(
        f"{root}/log"
    )
    if operation in ("append", "replace") and _chain(spark, root, None).count() > CHAIN:
        compact(spark, root, committed_at, by)
    return new


def compact(spark: SparkSession, root: str, committed_at: datetime, by: tuple[str, ...] = ("brand",)) -> int:
    """The newest state as one commit. Older snapshots stay readable until they expire."""
    return commit(read_as_of(spark, root), root, "compact", committed_at, by)


def expire(spark: SparkSession, root: str, before: datetime) -> list[int]:
    """Forget snapshots that were replaced before a point in time; returns the ids whose rows were deleted.

    What a reader as of that time or later needs stays: the newest snapshot up to it, and the chain that this one
    stands on. The mark that ids below have expired is written first, then their folders go; what a crash leaves
    of them goes with the next call.
    """
    oldest = snapshot_at(spark, root, before)
    if oldest is None:
        return []
    below = _chain(spark, root, oldest).agg(F.min("snapshot_id")).first()[0]
    spark.createDataFrame([(below,)], EXPIRED).coalesce(1).write.mode("append").parquet(f"{root}/expired")
    gone = []
    for (name,) in children(spark, f"{root}/data", "snapshot_id=*"):
        number = int(name.removeprefix("snapshot_id="))
        if number < below:
            remove(spark, f"{root}/data/{name}")
            gone.append(number)
    return sorted(gone)


def _chain(spark: SparkSession, root: str, snapshot_id: int | None) -> DataFrame:
    """Log rows from the last commit of the whole table up to a snapshot, or the newest."""
    log = snapshot_log(spark, root)
    until = log if snapshot_id is None else log.filter(F.col("snapshot_id") <= snapshot_id)
    first, last = until.agg(
        F.coalesce(F.max(F.when(F.col("operation").isin(WHOLE), F.col("snapshot_id"))), F.min("snapshot_id")),
        F.max("snapshot_id"),
    ).first()
    if last is None or (snapshot_id is not None and last != snapshot_id):
        raise ValueError(f"no snapshot {snapshot_id}")
    return log.filter(F.col("snapshot_id").between(first, last))


def list_snapshots(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Newest first by commit time, then id. `committed_at` is epoch ms as text."""
    return (
        snapshot_log(spark, root)
        .select(
            F.lit(table).alias("table"), "snapshot_id",
            F.unix_millis("committed_at").cast("string").alias("committed_at"),
            F.coalesce("operation", F.lit("unknown")).alias("operation"),
            "added_records",
        )
        .orderBy(F.col("committed_at").cast("bigint").desc(), F.desc("snapshot_id"))
    )


def snapshot_at(spark: SparkSession, root: str, when: datetime) -> int | None:
    """Id of the newest snapshot committed up to a point in time."""
    row = (
        snapshot_log(spark, root).filter(F.col("committed_at") <= F.lit(when))
        .agg(F.max_by("snapshot_id", F.struct("committed_at", "snapshot_id"))).first()
    )
    return row[0]


def read_as_of(spark: SparkSession, root: str, snapshot_id: int | None = None, row_filter=None) -> DataFrame:
    """The table as of a snapshot (default: the newest).

    The chain runs from the last overwrite or compaction up to that id: a range on the folder
    column, so other snapshots are pruned. The filter reaches the scan as well. Columns have the
    types they were written with, so a brand named '007' stays one; a column that an
    older snapshot lacks is null there.
    """
    chain = _chain(spark, root, snapshot_id).orderBy("snapshot_id").collect()
    schema = T.StructType()
    for f in (f for c in chain for f in T.StructType.fromJson(json.loads(c["columns"])).fields):
        if f.name not in schema.names:
            schema = schema.add(f.name, f.dataType)
    columns = list(schema.names)
    rows = spark.read.schema(schema.add("snapshot_id", T.LongType())).parquet(f"{root}/data")
    rows = rows.filter(F.col("snapshot_id").isin([c["snapshot_id"] for c in chain]))
    if row_filter is not None:
        rows = rows.filter(row_filter)
    replaced = [c["snapshot_id"] for c in chain if c["operation"] == "replace"]
    if replaced:
        # Only the keys of replacing snapshots meet; a group's rows count from its newest one on.
        newest = rows.filter(F.col("snapshot_id").isin(replaced)).groupBy(*GROUP).agg(F.max("snapshot_id").alias("since"))
        rows = rows.join(newest, GROUP, "left").filter(F.col("since").isNull() | (F.col("snapshot_id") >= F.col("since")))
    return rows.select(*columns)


def changes(spark: SparkSession, root: str, after: int, until: int) -> DataFrame:
    """Per fact key that snapshot `until` has otherwise than `after`: spend in both, and whether it was added, removed or changed.

    Equal to `snapshot_full_outer` of both without what was kept, but only the commits in between are read, and of the older ones
    the brands and weeks that those name. An overwrite in between names all, so then both snapshots are read.
    """
    log = snapshot_log(spark, root).filter((F.col("snapshot_id") > after) & (F.col("snapshot_id") <= until)).collect()
    between = [r["snapshot_id"] for r in log if r["operation"] != "compact"]
    before, now = read_as_of(spark, root, after), read_as_of(spark, root, until)
    if not any(r["operation"] == "overwrite" for r in log):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in GROUP]).add("snapshot_id", T.LongType())
        at = [f"{root}/data/snapshot_id={i}" for i in between]
        rows = spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*at) if at else spark.createDataFrame([], schema)
        named = staged(rows.select(*GROUP).distinct(), "named")
        before, now = (only_partitions(df, named, ["brand"]).join(named, GROUP, "left_semi") for df in (before, now))
    return snapshot_full_outer(before, now).filter("state <> 'kept'")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Total spend per brand in both snapshots, change and percent; no rows count as 0."""
    def total(df: DataFrame, prev: int) -> DataFrame:
        return df.select("brand", F.lit(prev).alias("is_prev"), exact(F.col("spend_midpoint")).alias("spend"))

    both = total(previous, 1).unionAll(total(current, 0)).groupBy("brand").agg(
        *[
            F.coalesce(amount(F.sum(F.when(F.col("is_prev") == k, F.col("spend")))), F.lit(0.0)).alias(n)
            for k, n in ((1, "spend_prev"), (0, "spend_cur"))
        ]
    )
    return both.select(
        "brand", "spend_prev", "spend_cur",
        (F.col("spend_cur") - F.col("spend_prev")).alias("delta"),
        pct_change(F.col("spend_cur"), F.col("spend_prev")).alias("pct"),
    )


def snapshot_full_outer(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Per fact key: spend in both snapshots, and whether it was added, removed,
    changed or kept."""
    keys = ["brand", "week_key", "channel", "region"]
    a = previous.select(*keys, F.col("spend_midpoint").alias("spend_prev"))
    b = current.select(*keys, F.col("spend_midpoint").alias("spend_cur"))
    state = (
        F.when(F.col("spend_prev").isNull(), "added")
        .when(F.col("spend_cur").isNull(), "removed")
        .when(F.col("spend_prev") != F.col("spend_cur"), "changed")
        .otherwise("kept")
    )
    return a.join(b, keys, "full").select(*keys, "spend_prev", "spend_cur", state.alias("state"))
