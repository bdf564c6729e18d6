"""The weekly fact table: one row per brand, ISO week, channel and region."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.functions.numbers import amount, exact, share
from spendtide.operators.clean import UNKNOWN

GRAIN = ["brand", "week_key", "channel", "region"]
BRAND_WEEK = ["brand", "week_key"]
# What the fact table is made from.
INPUT = [
    *GRAIN, "is_active", "impression_lower", "impression_upper", "spend_lower", "spend_upper", "cta", "creative_themes",
]

# Lengths of the top lists.
N_CTAS = 3
N_THEMES = 5


def _base(creatives: DataFrame, also: list[str] = []) -> DataFrame:  # noqa: B006
    """Only the columns the measures need, nulls filled."""
    return creatives.select(
        *also,
        "brand", "week_key", "channel",
        F.coalesce("region", F.lit(UNKNOWN)).alias("region"),
        F.col("is_active"),
        F.coalesce("impression_lower", F.lit(0)).cast("bigint").alias("impression_lower"),
        F.coalesce("impression_upper", F.lit(0)).cast("bigint").alias("impression_upper"),
        exact(F.col("spend_lower")).alias("spend_lower"),
        exact(F.col("spend_upper")).alias("spend_upper"),
    )


def _measures() -> list[Column]:
    return [
        F.count("*").alias("ad_count"),
        F.count_if("is_active").alias("active_ad_count"),
        F.sum("impression_lower").alias("impression_lower_sum"),
        F.sum("impression_upper").alias("impression_upper_sum"),
        F.sum("spend_lower").alias("spend_lower_sum"),
        F.sum("spend_upper").alias("spend_upper_sum"),
    ]


def _finish(exact: DataFrame, *lists: str) -> DataFrame:
    """Exact sums to doubles, plus midpoint and share of the brand's week.

    The sum of midpoints is half the sum of both bounds, so it needs no buffer of
    its own. A brand's week holds channels x regions rows: a small window.
    """
    both = F.col("spend_lower_sum") + F.col("spend_upper_sum")
    total = F.sum(both).over(Window.partitionBy(*BRAND_WEEK))
    return exact.select(
        *GRAIN, "ad_count", "active_ad_count", "impression_lower_sum", "impression_upper_sum",
        amount(F.col("spend_lower_sum")).alias("spend_lower_sum"),
        amount(F.col("spend_upper_sum")).alias("spend_upper_sum"),
        (amount(both) / 2).alias("spend_midpoint"),
        *lists,
        share(amount(both), amount(total)).alias("channel_share"),
    )


def weekly_measures(creatives: DataFrame) -> DataFrame:
    """Counts, sums and channel share without the top lists."""
    return _finish(_base(creatives).groupBy(*GRAIN).agg(*_measures()))


def _value_counts(creatives: DataFrame, kinds: tuple[int, ...] = (1, 2), also: list[str] = []) -> DataFrame:  # noqa: B006
    """How often each call to action (kind 1) and theme (kind 2) occurs in each group."""
    group = [F.col("brand"), F.col("week_key"), F.col("channel"),
             F.coalesce("region", F.lit(UNKNOWN)).alias("region"), *also]
    ctas = creatives.filter(F.col("cta") != UNKNOWN).select(
        *group, F.lit(1).alias("kind"), F.col("cta").alias("value")) if 1 in kinds else None
    themes = creatives.select(
        *group, F.lit(2).alias("kind"), F.explode("creative_themes").alias("value")
    ).filter(F.col("value") != UNKNOWN) if 2 in kinds else None
    counted = [df.groupBy(*GRAIN, *also, "kind", "value").agg(F.count("*").alias("n")) for df in (ctas, themes) if df is not None]
    return counted[0] if len(counted) == 1 else counted[0].unionAll(counted[1])


def _top_values(counts: DataFrame) -> DataFrame:
    """Most frequent calls to action (kind 1) and themes (kind 2) of each group.

    Counting comes before ranking, so no group ever gathers its values in a list,
    and the rank filter cuts each task's output to a few rows per group before the
    second shuffle.
    """
    w = Window.partitionBy(*GRAIN, "kind").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= N_THEMES)
        .filter((F.col("kind") == 2) | (F.col("rank") <= N_CTAS))
        .drop("n")
    )


def weekly_signals(creatives: DataFrame, batch_ts: Column | None = None) -> DataFrame:
    """The whole fact table. `batch_ts` stamps the rows; without it there is no stamp.

    Measures, calls to action and themes are three reads of the input, each of only
    its columns and each reduced before its shuffle. One wide pass that explodes
    every facet next to the measures was three times slower. Feed it a written
    table (as `plans.weekly_run` does), so that no work above it is repeated.
    """
    measures = _base(creatives).groupBy(*GRAIN).agg(*_measures())
    return _assembled(measures, _top_values(_value_counts(creatives)), batch_ts)


def partial_signals(creatives: DataFrame, also: list[str] = []) -> DataFrame:  # noqa: B006
    """Partial aggregates that add up: a row of measures per group (kind 0), and a row of counts per call to action and theme.

    `also` names further columns to group by, as that of the load. Feed it a written table: it is read three times.
    """
    measures = _base(creatives, also).groupBy(*GRAIN, *also).agg(*_measures())
    measures = measures.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("spend_lower_sum", "spend_upper_sum")})
    sums = [c for c in measures.columns if c not in GRAIN and c not in also]
    none = [F.lit(None).cast(measures.schema[c].dataType).alias(c) for c in sums]
    counts = _value_counts(creatives, also=also).select(*GRAIN, "kind", "value", "n", *none, *also)
    return measures.select(*GRAIN, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n"), *sums, *also).unionAll(counts)


def added_up(partials: DataFrame) -> DataFrame:
    """Partial aggregates with one row per group, kind and value: those of any number of loads as those of one."""
    sums = ["n", "ad_count", "active_ad_count", "impression_lower_sum", "impression_upper_sum"]
    money = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("spend_lower_sum", "spend_upper_sum")]
    return partials.groupBy(*GRAIN, "yr", "kind", "value").agg(*[F.sum(c).alias(c) for c in sums], *money)


def merged_signals(partials: DataFrame, batch_ts: Column | None = None) -> DataFrame:
    """The fact table from partial aggregates of any number of loads, in any order."""
    sums = ["ad_count", "active_ad_count", "impression_lower_sum", "impression_upper_sum"]
    money = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("spend_lower_sum", "spend_upper_sum")]
    measures = partials.filter("kind = 0").groupBy(*GRAIN).agg(*[F.sum(c).alias(c) for c in sums], *money)
    counts = partials.filter("kind > 0").groupBy(*GRAIN, "kind", "value").agg(F.sum("n").alias("n"))
    return _assembled(measures, _top_values(counts), batch_ts)


def _assembled(measures: DataFrame, tops: DataFrame, batch_ts: Column | None) -> DataFrame:
    def top(kind: int, name: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("rank", "value"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["value"]).alias(name)

    # One measure row and at most 8 list rows per group, laid out by brand and week
    # once: the grouping and the share window both fit that layout.
    exact = (
        measures.unionByName(tops, allowMissingColumns=True)
        .repartition(*BRAND_WEEK)
        .groupBy(*GRAIN)
        .agg(
            *[F.max(c).alias(c) for c in measures.columns if c not in GRAIN],
            top(1, "top_ctas"), top(2, "top_themes"),
        )
    )
    out = _finish(exact, "top_ctas", "top_themes")
    return out if batch_ts is None else out.withColumn("etl_timestamp", batch_ts.cast("timestamp"))


def top_n_per_key(df: DataFrame, keys: list[str], value: str, n: int, count: str = "n_ads") -> DataFrame:
    """The n most frequent values per key as rows: keys, value, count, rank; ties by value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(count))
    w = Window.partitionBy(*keys).orderBy(F.desc(count), F.asc(value))
    # The filter reads the bare row number: only so does it become a group limit.
    top = counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def _at_grain(creatives: DataFrame, value: Column, name: str) -> DataFrame:
    return creatives.select(
        "brand", "week_key", "channel", F.coalesce("region", F.lit(UNKNOWN)).alias("region"), value.alias(name)
    )


def top_ctas(creatives: DataFrame, n: int = N_CTAS) -> DataFrame:
    stated = creatives.filter(F.col("cta") != UNKNOWN)
    return top_n_per_key(_at_grain(stated, F.col("cta"), "cta"), GRAIN, "cta", n)


def top_themes(creatives: DataFrame, n: int = N_THEMES) -> DataFrame:
    themes = _at_grain(creatives, F.explode("creative_themes"), "theme").filter(F.col("theme") != UNKNOWN)
    return top_n_per_key(themes, GRAIN, "theme", n)


def listed_themes(creatives: DataFrame) -> DataFrame:
    """The themes that each fact row lists, as rows, without making the fact rows."""
    return _top_values(_value_counts(creatives, (2,))).select(*GRAIN, F.col("value").alias("theme"))


def active_count(creatives: DataFrame) -> DataFrame:
    """Ads and active ads per group; a missing flag is not active."""
    return (
        creatives.groupBy("brand", "week_key", "channel", F.coalesce("region", F.lit(UNKNOWN)).alias("region"))
        .agg(F.count("*").alias("ad_count"), F.count_if("is_active").alias("active_ad_count"))
    )


def attach_total(signals: DataFrame) -> DataFrame:
    """Each row with its brand-week total, and the share of the channel as a whole.

    `channel_share` is the share of one channel in one region;
    `channel_share_total` adds up the channel's regions.
    """
    spend = exact(F.col("spend_midpoint"))
    total = amount(F.sum(spend).over(Window.partitionBy(*BRAND_WEEK)))
    channel = amount(F.sum(spend).over(Window.partitionBy(*BRAND_WEEK, "channel")))
    return signals.withColumns({
        "brand_week_spend": total,
        "channel_share_total": share(channel, total),
    })
