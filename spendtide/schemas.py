"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the two public tables.
RAW_CREATIVES = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("brand", T.StringType(), False),
    T.StructField("brand_display", T.StringType()),
    T.StructField("ad_text", T.StringType()),
    T.StructField("cta", T.StringType()),
    T.StructField("channel", T.StringType(), False),
    T.StructField("platform", T.StringType()),
    T.StructField("impression_lower", T.LongType()),
    T.StructField("impression_upper", T.LongType()),
    T.StructField("spend_lower", T.DoubleType()),
    T.StructField("spend_upper", T.DoubleType()),
    T.StructField("started_running", T.StringType()),
    T.StructField("stopped_running", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("currency", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("creative_themes", T.ArrayType(T.StringType())),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("week_key", T.StringType(), False),
])

# Counts are bigint: that is what Spark's own aggregates return.
WEEKLY_SIGNALS = T.StructType([
    T.StructField("brand", T.StringType(), False),
    T.StructField("week_key", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("region", T.StringType()),
    T.StructField("ad_count", T.LongType()),
    T.StructField("active_ad_count", T.LongType()),
    T.StructField("impression_lower_sum", T.LongType()),
    T.StructField("impression_upper_sum", T.LongType()),
    T.StructField("spend_lower_sum", T.DoubleType()),
    T.StructField("spend_upper_sum", T.DoubleType()),
    T.StructField("spend_midpoint", T.DoubleType()),
    T.StructField("top_ctas", T.ArrayType(T.StringType())),
    T.StructField("top_themes", T.ArrayType(T.StringType())),
    T.StructField("channel_share", T.DoubleType()),
    T.StructField("etl_timestamp", T.TimestampType()),
])

_BOUNDS = T.StructType([
    T.StructField("lower_bound", T.StringType()),
    T.StructField("upper_bound", T.StringType()),
    T.StructField("currency", T.StringType()),
])

# One ad as an ad archive returns it. Numbers arrive as text.
ARCHIVE_AD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ad_creative_body", T.StringType()),
    T.StructField("ad_delivery_start_time", T.StringType()),
    T.StructField("ad_delivery_stop_time", T.StringType()),
    T.StructField("impressions", _BOUNDS),
    T.StructField("spend", _BOUNDS),
    T.StructField("publisher_platforms", T.ArrayType(T.StringType())),
])

ARCHIVE_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(ARCHIVE_AD)),
    T.StructField("paging", T.StructType([T.StructField("next", T.StringType())])),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of `schema`, in its order and types; absent ones become null.

    Casts are lenient (`try_cast`): one unreadable value must not stop the job.
    NaN and infinities count as missing.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema.fields:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        else:
            c = F.col(f.name)
            if isinstance(have[f.name], (T.DoubleType, T.FloatType)):
                c = F.when(F.abs(c) < float("inf"), c)
            if have[f.name] != f.dataType:
                c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)
