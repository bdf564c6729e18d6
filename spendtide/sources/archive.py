"""Ad-archive responses: landed pages of nested ads -> creatives."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtide.functions.calendar import iso_week_key, lenient_date
from spendtide.functions.labels import brand_slug, channel_of_platform, first_platform, title_case
from spendtide.functions.numbers import double_or_zero, long_or_zero
from spendtide.functions.text import sanitize
from spendtide.schemas import ARCHIVE_AD, ARCHIVE_PAGE

# What the archive does not state.
SOURCE = "meta"
CTA = "Learn More"
REGION = "US"
CURRENCY = "USD"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one JSON envelope per line: data, paging, brand, page_index, and the cursor it was asked for by.

    `pagewalk.walked_pages` numbers pages by their cursors, whatever page_index says.
    """
    walk = [T.StructField("brand", T.StringType()), T.StructField("page_index", T.LongType()), T.StructField("cursor", T.StringType())]
    return spark.read.schema(T.StructType(ARCHIVE_PAGE.fields + walk)).json(path)


def explode_ad_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row per ad from all landed pages, or from the first `max_pages` of each walk."""
    if max_pages is not None:
        pages = pages.filter(F.col("page_index") < max_pages)
    return pages.select(
        *[c for c in pages.columns if c not in ("data", "paging")], F.explode("data").alias("ad")
    )


def parse_ads(df: DataFrame, json: str) -> DataFrame:
    """A column of JSON ads -> a struct column `ad`; other columns are kept."""
    return df.withColumn("ad", F.from_json(F.col(json), ARCHIVE_AD)).drop(json)


def normalise_ads(ads: DataFrame, as_of: Column, batch_ts: Column) -> DataFrame:
    """Columns `ad` and `brand` (the search term) -> creatives.

    A missing or unreadable start date becomes `as_of`; an unreadable stop date
    counts as none. An ad with a stop date, even a future one, is inactive.
    """
    ad = F.col("ad")
    started = F.coalesce(lenient_date(ad["ad_delivery_start_time"]), as_of)
    stopped = lenient_date(ad["ad_delivery_stop_time"])
    platform = first_platform(ad["publisher_platforms"])
    return ads.select(
        F.coalesce(ad["id"], F.lit("")).alias("source_id"),
        F.lit(SOURCE).alias("source"),
        brand_slug(F.col("brand")).alias("brand"),
        title_case(F.col("brand")).alias("brand_display"),
        sanitize(F.coalesce(ad["ad_creative_body"], F.lit(""))).alias("ad_text"),
        F.lit(CTA).alias("cta"),
        channel_of_platform(platform).alias("channel"),
        platform.alias("platform"),
        long_or_zero(ad["impressions"]["lower_bound"]).alias("impression_lower"),
        long_or_zero(ad["impressions"]["upper_bound"]).alias("impression_upper"),
        double_or_zero(ad["spend"]["lower_bound"]).alias("spend_lower"),
        double_or_zero(ad["spend"]["upper_bound"]).alias("spend_upper"),
        started.alias("started_running"),
        stopped.alias("stopped_running"),
        stopped.isNull().alias("is_active"),
        F.coalesce(ad["spend"]["currency"], F.lit(CURRENCY)).alias("currency"),
        F.lit(REGION).alias("region"),
        F.array().cast("array<string>").alias("creative_themes"),
        batch_ts.cast("timestamp").alias("ingested_at"),
        iso_week_key(started).alias("week_key"),
    )
