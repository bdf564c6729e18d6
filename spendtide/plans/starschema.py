"""Creatives derived from order lines, the input of the registered queries.

The dimension joins carry no hints: the planner broadcasts a dimension only when
its files are below the session's threshold, and shuffles it otherwise.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spendtide.functions.calendar import iso_week_key

# Label tables of the mapping.
SOURCE = {"N": "meta", "A": "google", "R": "synthetic"}
CHANNEL = {
    "1-URGENT": "social",
    "2-HIGH": "search",
    "3-MEDIUM": "video",
    "4-NOT SPECIFIED": "display",
    "5-LOW": "ctv",
}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Its schema is read once per session, not per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _lookup(col: str, values: dict[str, str]):
    out = F
    for k, v in values.items():
        out = out.when(F.col(col) == k, v)
    return out


def four_places(x: Column) -> Column:
    return F.rint(x * 10000) / 10000


def creatives(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Typed creatives, one row per order line. `lines` may be a stream."""
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    # Labels are derived on the dimension rows, before the joins multiply them.
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        _lookup("o_orderpriority", CHANNEL).alias("channel"),
        F.col("o_orderdate").cast("date").alias("started_running"),
        iso_week_key(F.col("o_orderdate").cast("date")).alias("week_key"),
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.lower("c_mktsegment").alias("brand"), F.col("c_mktsegment").alias("brand_display")
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size",
        F.col("p_name").alias("ad_text"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("cta"),
        F.col("p_brand").alias("platform"),
        F.split("p_name", " ").alias("creative_themes"),
    )
    # Dimensions meet on the orders, so the lines, the widest side, move for two joins and not for one more with customers.
    placed = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    ordered = orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "channel", "started_running", "week_key", "brand", "brand_display", "r_name"
    )
    joined = lines.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lower = (F.col("l_quantity") * 1000).cast("bigint")
    return joined.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_id"),
        _lookup("l_returnflag", SOURCE).alias("source"),
        "brand", "brand_display", "ad_text", "cta", "channel", "platform",
        lower.alias("impression_lower"),
        (lower + F.col("p_size") * 100).alias("impression_upper"),
        four_places(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("spend_lower"),
        four_places(F.col("l_extendedprice")).alias("spend_upper"),
        "started_running",
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("date")).alias("stopped_running"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        F.lit("USD").alias("currency"),
        F.col("r_name").alias("region"),
        "creative_themes",
        F.col("l_shipdate").cast("timestamp").alias("ingested_at"),
        "week_key",
    )
