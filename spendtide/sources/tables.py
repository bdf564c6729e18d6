"""Partitioned tables on plain Parquet: append and replace. Insert-only loading is in `loads`.

Layout: partitions (brand, yr), where yr is the ISO year of the week. One
partition per brand and week gives files of a few rows; `by="week"` selects it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtide.functions.calendar import week_year
from spendtide.operators.dedup import KEY, complete
from spendtide.session import PACKED, Stages, path_exists

# Partition columns of the two layouts.
LAYOUTS = {"year": ["brand", "yr"], "week": ["brand", "week_key"]}

#: Partitions that are named one by one to a scan.
MOST_PARTITIONS = 1000


def with_layout(df: DataFrame, by: str = "year") -> DataFrame:
    return df.withColumn("yr", week_year(F.col("week_key"))) if by == "year" else df


def _write(df: DataFrame, path: str, by: str, mode: str, **options) -> None:
    """One rebalanced write. Rows meet by partition, so each gets few files; adaptive
    execution splits a partition that holds a large part of all rows."""
    cols = LAYOUTS[by]
    df = with_layout(df, by)
    df.hint("rebalance", *[F.col(c) for c in cols]).write.mode(mode).options(compression=PACKED, **options).partitionBy(*cols).parquet(path)


def stored_schema(schema: T.StructType, by: str = "year") -> T.StructType:
    """Columns as stored. Declared, so that a brand named '361' is not read as a number."""
    out = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return out.add("yr", T.StringType()) if by == "year" and "yr" not in out.names else out


def read_table(spark: SparkSession, path: str, schema: T.StructType, by: str = "year") -> DataFrame:
    """The table's columns in the schema's order, without the layout column."""
    return spark.read.schema(stored_schema(schema, by)).parquet(path).select(*schema.names)


def append_rows(df: DataFrame, path: str, by: str = "year") -> None:
    _write(df, path, by, "append")


def overwrite_or_append(df: DataFrame, path: str, mode: str = "overwrite", by: str = "year") -> None:
    """Replace the whole table, or add to it."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    _write(df, path, by, mode, partitionOverwriteMode="static")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there. What else is wrong with it must not look like an empty table."""
    return path_exists(spark, path)


def only_partitions(stored: DataFrame, wanted: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of `stored` in the partitions that `wanted`, a written table, has rows in.

    Up to MOST_PARTITIONS value pairs become literals of the scan's partition filter: they prune files before the scan
    starts, which a join does only where the planner finds it worth it. More stay in Spark, as a semi join.
    """
    pairs = wanted.select(*cols).distinct()
    some = pairs.limit(MOST_PARTITIONS + 1).collect()
    if len(some) > MOST_PARTITIONS:
        return stored.join(pairs, cols, "left_semi")
    def text(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    names = ["\x00".join("" if v is None else f"={v}" for v in r) for r in some]
    return stored.filter(F.concat_ws("\x00", *[text(c) for c in cols]).isin(names) if names else F.lit(False))


def overwrite_weeks(df: DataFrame, path: str, by: str = "year") -> int:
    """Replace the (brand, week) groups that `df` holds; every other row stays. Returns how many rows `df` has.

    A partition holds many weeks, so its other weeks are read back and written
    along. The result is staged first: a partition is never read while it is
    replaced. Only the partitions that `df` names are read.

    Spark moves the new files in one commit, which a crash of the driver can cut short. A table that must
    survive that is kept as snapshots: `snapshots.commit(df, root, "replace", ...)`.
    """
    spark = df.sparkSession
    cols = LAYOUTS[by]
    fresh = with_layout(df, by)
    with Stages(spark) as stages:
        fresh = stages.write(fresh, "fresh")
        weeks = stages.write(fresh.groupBy("brand", "week_key", *[c for c in cols if c == "yr"]).agg(F.count("*").alias("n")), "weeks")
        n = weeks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if by == "year" and exists(spark, path):
            old = only_partitions(spark.read.schema(fresh.schema).parquet(path), weeks, cols)
            keep = old.join(weeks.select("brand", "week_key"), ["brand", "week_key"], "left_anti")
            fresh = stages.write(fresh.unionByName(keep.select(*fresh.columns)), "replace")
        fresh.hint("rebalance", *[F.col(c) for c in cols]).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*cols).parquet(path)
        return n


def rejects(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The rows that no load stores, with the reason: an incomplete key, no brand, no week."""
    reason = (
        F.when(~complete(keys), "key").when(~complete(["brand"]), "brand").when(~complete(["week_key"]), "week")
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def touched_weeks(stored: DataFrame, added: DataFrame) -> DataFrame:
    """All stored rows of the (brand, week) groups that `added` (a written table) has rows in.

    Only the partitions that `added` names are read.
    """
    keys = ["brand", "yr", "week_key"]
    some = only_partitions(stored, added, keys[:2])
    return some.join(added.select(*keys).distinct(), keys, "left_semi")


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str, by: str = "week") -> None:
    """Catalog table with the given columns, partitioned by the layout."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    if by == "year":
        cols += ", yr string"
    parts = ", ".join(LAYOUTS[by])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet PARTITIONED BY ({parts}) LOCATION '{location}'"
    )
