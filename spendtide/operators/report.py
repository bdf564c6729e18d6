"""Reports on the weekly fact table, for all brands at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.functions.labels import brand_slug
from spendtide.functions.numbers import amount, exact
from spendtide.operators.clean import filter_brand_channels
from spendtide.operators.trend import recent_weeks, trend
from spendtide.operators.weekly import top_n_per_key

# Weeks in the mix and in the totals, list lengths, page sizes.
MIX_WEEKS = 4
TOTAL_WEEKS = 8
N_THEMES = 5
PAGE = 100
MAX_PAGE = 1000


def _units() -> Column:
    return F.sum(exact(F.col("spend_midpoint")))


def _spend() -> Column:
    return amount(_units())


def channel_mix(signals: DataFrame, n: int = MIX_WEEKS) -> DataFrame:
    """Spend and percentage per channel over each brand's last n weeks."""
    spent = recent_weeks(signals, n).groupBy("brand", "channel").agg(_units().alias("spend"))
    total = amount(F.sum("spend").over(Window.partitionBy("brand")))
    pct = amount(F.col("spend")) / F.when(total == 0, 1.0).otherwise(total) * 100
    return spent.select(
        "brand", "channel", amount(F.col("spend")).alias("spend"), F.round(pct, 1).alias("pct")
    )


def mix_desc(signals: DataFrame, n: int = MIX_WEEKS) -> DataFrame:
    """The mix with its rank, largest percentage first, ties by channel."""
    w = Window.partitionBy("brand").orderBy(F.desc("pct"), F.asc("channel"))
    return channel_mix(signals, n).withColumn("rank", F.row_number().over(w).cast("bigint"))


def weekly_totals(signals: DataFrame, n: int = TOTAL_WEEKS) -> DataFrame:
    """Total spend of each of the brand's last n weeks."""
    return (
        recent_weeks(signals, n).groupBy("brand", "week_key")
        .agg(_spend().alias("spend"))
    )


def tail_weeks(signals: DataFrame, brand: str, n: int = TOTAL_WEEKS) -> DataFrame:
    """One brand's last n weekly totals, newest first."""
    return (
        filter_brand_channels(signals, brand).groupBy("week_key")
        .agg(_spend().alias("spend"))
        .orderBy(F.desc("week_key")).limit(n)
    )


def brand_top_themes(signals: DataFrame, n: int = N_THEMES) -> DataFrame:
    """Themes by the number of fact rows that list them; ties by name."""
    return brand_listed_themes(signals.select("brand", F.explode("top_themes").alias("theme")), n)


def brand_listed_themes(listed: DataFrame, n: int = N_THEMES) -> DataFrame:
    """The same from `weekly.listed_themes`, where the fact table is not at hand."""
    return top_n_per_key(listed, ["brand"], "theme", n, "n_rows")


def dominant(directions: DataFrame) -> DataFrame:
    """Most common direction over a brand's channels; ties go to the direction of
    the alphabetically first channel among the tied."""
    votes = directions.groupBy("brand", "trend_direction").agg(
        F.count("*").alias("n_channels"), F.min("channel").alias("first_channel")
    )
    w = Window.partitionBy("brand").orderBy(F.desc("n_channels"), F.asc("first_channel"))
    return (
        votes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
        .select("brand", F.col("trend_direction").alias("dominant_trend"), "n_channels")
    )


def dominant_trend(signals: DataFrame) -> DataFrame:
    return dominant(trend(signals))


def kpis(signals: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """Spend, ads, weeks and channels per brand; a brand without rows gets zeros."""
    out = signals.groupBy("brand").agg(
        _spend().alias("total_spend"),
        F.sum("ad_count").alias("total_ads"),
        F.count_distinct("week_key").alias("n_weeks"),
        F.count_distinct("channel").alias("n_channels"),
    )
    if brands is not None:
        out = brands.select("brand").distinct().join(out, "brand", "left").fillna(0)
    return out


def weeks_analysed(signals: DataFrame) -> DataFrame:
    return signals.groupBy("brand").agg(F.count_distinct("week_key").alias("weeks_analysed"))


def trend_series(signals: DataFrame) -> DataFrame:
    """Points of the trend chart: spend per brand, channel and week."""
    return signals.groupBy("brand", "channel", "week_key").agg(_spend().alias("spend"))


def trend_wide(signals: DataFrame, channels: list[str]) -> DataFrame:
    """The same points with one column per channel."""
    return signals.groupBy("brand", "week_key").pivot("channel", channels).agg(_spend())


def wow_delta(signals: DataFrame) -> DataFrame:
    """Newest week against the one before it that has rows. Null without a positive base."""
    w = Window.partitionBy("brand").orderBy(F.desc("week_key"))
    weeks = signals.groupBy("brand", "week_key").agg(
        _spend().alias("spend"), F.sum("ad_count").alias("ads")
    )
    both = (
        weeks.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
        .groupBy("brand").agg(
            F.max(F.when(F.col("_rn") == 1, F.col("week_key"))).alias("week_key"),
            *[
                F.max(F.when(F.col("_rn") == k, F.col(c))).alias(f"{tag}_{c}")
                for c in ("spend", "ads") for k, tag in ((1, "cur"), (2, "prev"))
            ],
        )
    )

    def pct(c: str) -> Column:
        cur, prev = F.col(f"cur_{c}"), F.col(f"prev_{c}")
        return F.when(prev > 0, (cur - prev) / prev * 100).alias(f"{c}_pct")

    return both.select("brand", "week_key", pct("spend"), pct("ads"))


def sorted_dims(signals: DataFrame) -> DataFrame:
    """Distinct brands and channels: dim, value. The facts are evaluated once, for their distinct pairs."""
    pairs = signals.select("brand", "channel").distinct()
    dims = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in ("brand", "channel")])
    return pairs.select(F.inline(dims)).distinct().orderBy("dim", "value")


def signal_projection(signals: DataFrame) -> DataFrame:
    """The six public columns, nulls as 0."""
    return signals.select(
        "brand", "channel", "week_key",
        F.coalesce(F.col("spend_midpoint").cast("double"), F.lit(0.0)).alias("spend_midpoint"),
        F.coalesce(F.col("ad_count").cast("bigint"), F.lit(0)).cast("bigint").alias("ad_count"),
        F.coalesce(F.col("channel_share").cast("double"), F.lit(0.0)).alias("channel_share"),
    )


def signals_query(signals: DataFrame, brand: str, channel: str | None = None, limit: int = PAGE) -> DataFrame:
    """Newest rows of one brand. An unknown brand gives an empty frame.

    The order is total (week, channel, region), so the page is the same each time.
    """
    if not 0 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be at most {MAX_PAGE}")
    rows = signals.filter(F.col("brand") == brand_slug(F.lit(brand)))
    if channel:
        rows = rows.filter(F.col("channel") == channel)
    page = rows.orderBy(F.desc("week_key"), F.asc("channel"), F.asc_nulls_last("region")).limit(limit)
    return signal_projection(page)
