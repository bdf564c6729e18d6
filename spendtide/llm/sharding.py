"""Sharding: a k-d tree over metadata, cut at weighted medians."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtide.llm.common import running_total, scratch, staged

def ranked_codes(rows: DataFrame, texts: list[str]) -> DataFrame:
    """`rows` with a column `<text>_code` for each of `texts`: the text's place among its distinct values in byte order, from 0; -1 for null.

    Distinct values are numbered by ranges, so there may be any number of them. A value that a third of all rows
    share is one row of that table, and the join's other side can be split.
    """
    out = rows
    for c in texts:
        values = rows.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("text_")).distinct().withColumn("of_", F.lit(0))
        codes = running_total(values, "of_", ["text_"], F.lit(1), "code_").select("text_", F.col("code_").cast("bigint").alias(f"{c}_code"))
        out = out.join(codes, F.col(c).cast("string") == F.col("text_"), "left").drop("text_")
        out = out.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1).cast("bigint")))
    return out


@scratch
def kd_shards(rows: DataFrame, dims: list[str], weight: str, ties: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """`rows` with a column `shard` from 0 on, shards being of about equal total weight.

    There are `shards` of them, or as many as it takes for leaves of at most `target_bytes` of weight, but for
    the part of a row that crosses a cut. Each round splits every node that has to give k > 1 shards. The node's axis is the
    dimension with the largest extent relative to the whole table's (the first at a tie).
    Its rows are ordered by (axis, `ties`, all dimensions); a row goes left if the middle
    of its weight lies within the first (k // 2) / k of the node's weight. So a value that
    a third of all rows share is cut through, by its ties. A null dimension counts as -1.
    Rows that agree in every one of these columns are interchangeable. An empty table
    stays empty. With fewer rows than shards some shards are empty. A column `shard` of `rows` is replaced; other
    columns may have any name. Texts are not read: what the dimensions and weight say of long ones counts.

    A round is a range exchange of narrow rows, prefix sums by range, and one row of
    totals per range and node; nothing is gathered in one task.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    own = [c for c in rows.columns if c != "shard"]
    n, m = len(dims), len(ties)
    points = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")).alias(f"dim_{i}") for i, c in enumerate(dims)],
        *[F.col(c).alias(f"tie_{i}") for i, c in enumerate(ties)], F.col(weight).cast("bigint").alias("weight_"), F.lit(0).alias("shard_"),
    )
    spans = [(F.max(f"dim_{i}") - F.min(f"dim_{i}")).cast("double") for i in range(n)]
    *whole, total = points.agg(*spans, F.coalesce(F.sum("weight_"), F.lit(0))).first()
    if target_bytes is not None:
        shards = max(1, -(-int(total) // target_bytes))
    points = points.withColumn("k_", F.lit(shards))
    rounds = max(0, (shards - 1).bit_length())
    for i in range(rounds):
        points = staged(_split(points, n, m, whole), "kd", keep=i == rounds - 1)
    return points.select(*[F.col(f"row_.`{c}`").alias(c) for c in own], F.col("shard_").alias("shard"))


def _split(points: DataFrame, n: int, m: int, whole: list) -> DataFrame:
    dims = [f"dim_{i}" for i in range(n)]
    nodes = points.groupBy("shard_").agg(
        F.sum("weight_").cast("decimal(38,0)").alias("node_weight"),
        *[((F.max(c) - F.min(c)).cast("double") / F.lit(float(w or 1) or 1.0)).alias(f"span_{i}") for i, (c, w) in enumerate(zip(dims, whole))],
    )
    spans = [F.col(f"span_{i}") for i in range(n)]
    widest = F.greatest(*spans) if n > 1 else spans[0]
    axis = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        axis = F.when(spans[i] == widest, i).otherwise(axis)
    nodes = staged(nodes.select("shard_", "node_weight", axis.alias("axis_")), "nodes")
    order = ["axis_value", *[f"tie_{i}" for i in range(m)], *dims]
    ranged = points.join(nodes, "shard_").withColumn("axis_value", F.get(F.array(*[F.col(c) for c in dims]), F.col("axis_")))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(parts, "shard_", *order).withColumn("range_", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    totals = ranged.groupBy("shard_", "range_").agg(F.sum("weight_").alias("range_weight"))
    before = Window.partitionBy("shard_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = staged(totals.select("shard_", "range_", F.coalesce(F.sum("range_weight").over(before), F.lit(0)).alias("before_")), "totals")
    within = Window.partitionBy("shard_", "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within_", F.coalesce(F.sum("weight_").over(within), F.lit(0))).join(totals, ["shard_", "range_"])
    middle = ((F.col("before_") + F.col("within_")) * 2 + F.col("weight_")).cast("decimal(38,0)")
    left_k = F.floor(F.col("k_") / 2).cast("int")
    # Compared as whole numbers, so no rounding decides.
    left = (F.col("k_") > 1) & (middle * F.col("k_") <= F.col("node_weight") * 2 * left_k)
    right = (F.col("k_") > 1) & ~left
    return placed.select(
        *[c for c in points.columns if c not in ("shard_", "k_")],
        F.when(right, F.col("shard_") + left_k).otherwise(F.col("shard_")).alias("shard_"),
        F.when(F.col("k_") == 1, 1).when(left, left_k).otherwise(F.col("k_") - left_k).alias("k_"),
    )


def number_rows(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with their rank by `order` within each group, from 0 and gapless; columns may have any names."""
    own = [c for c in rows.columns if c != name]
    by = [f"order_{i}" for i in range(len(order))]
    inner = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"), F.col(f"`{group}`").alias("group_"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, by)]
    )
    numbered = running_total(inner, "group_", by, F.lit(1), "number_")
    return numbered.select(*[F.col(f"row_.`{c}`").alias(c) for c in own], F.col("number_").alias(name))


def write_shards(rows: DataFrame, path: str) -> None:
    """Rows that have a `shard`, as one folder per shard; large shards are split over files."""
    rows.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)
