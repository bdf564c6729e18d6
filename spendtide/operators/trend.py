"""Spend trend per brand and channel, and the forecasts SQL can express.

Regions are summed first, so a series has one value per week: 'last 4' means four
weeks, not four region rows. A series is as long as the calendar, never as long
as the data.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.functions.calendar import iso_week_key, week_monday
from spendtide.functions.numbers import amount, clamp_round, exact, pct_change

SERIES = ["brand", "channel"]

# History needed, weeks compared, weeks shown, steps ahead, limits.
MIN_POINTS = 4
HALF = 4
N_ACTUALS = 12
PERIODS = 4
UP, DOWN = 10, -10


def direction(pct: Column) -> Column:
    """increasing / decreasing / flat; exactly at a limit is flat."""
    return F.when(pct > UP, "increasing").when(pct < DOWN, "decreasing").otherwise("flat")


def weekly_series(signals: DataFrame) -> DataFrame:
    """brand, channel, week_key, spend (in exact units)."""
    return signals.groupBy(*SERIES, "week_key").agg(F.sum(exact(F.col("spend_midpoint"))).alias("spend"))


def _shape(signals: DataFrame) -> DataFrame:
    """One row per series: length, ends, the two half sums, the last weeks."""
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("week_key"))
    rn = F.col("rn")
    recent = F.when(rn <= N_ACTUALS, F.struct("week_key", F.round(amount(F.col("spend")), 2).alias("y")))
    return (
        weekly_series(signals)
        .withColumn("rn", F.row_number().over(newest))
        .groupBy(*SERIES)
        .agg(
            F.count("*").alias("n_weeks"),
            amount(F.min_by("spend", "week_key")).alias("first"),
            amount(F.max_by("spend", "week_key")).alias("last"),
            amount(F.sum(F.when(rn <= HALF, F.col("spend")))).alias("recent_sum"),
            amount(F.sum(F.when((rn > HALF) & (rn <= 2 * HALF), F.col("spend")))).alias("prior_sum"),
            F.array_sort(F.collect_list(recent)).alias("tail"),
        )
    )


def _summary(shape: DataFrame, pct: Column, forecast: Column, *more: str) -> DataFrame:
    """The typed result, with columns `more` of the shape. A short series keeps its row, with empty lists and flat."""
    enough = F.col("n_weeks") >= MIN_POINTS
    pct = F.when(enough, pct).otherwise(0.0)

    def listed(values: Column, kind: str) -> Column:
        return F.when(enough, values).otherwise(F.array().cast(f"array<{kind}>"))

    return shape.select(
        *SERIES, "n_weeks",
        direction(pct).alias("trend_direction"),
        F.round(pct, 2).alias("trend_pct_change"),
        listed(forecast, "double").alias("forecast"),
        listed(F.transform("tail", lambda e: e["y"]), "double").alias("weekly_actuals"),
        listed(F.transform("tail", lambda e: e["week_key"]), "string").alias("weekly_dates"),
        *more,
    )


def half_pct() -> Column:
    """Last 4 weeks against the 4 before; with fewer than 8, last against first."""
    return F.when(
        F.col("n_weeks") >= 2 * HALF, pct_change(F.col("recent_sum"), F.col("prior_sum"))
    ).otherwise(pct_change(F.col("last"), F.col("first")))


def endpoint_forecast(periods: int = PERIODS) -> Column:
    """Last value plus the slope between both ends, step by step."""
    slope = (F.col("last") - F.col("first")) / F.greatest(F.col("n_weeks") - 1, F.lit(1))
    return F.transform(
        F.sequence(F.lit(1), F.lit(periods)), lambda i: clamp_round(F.col("last") + slope * i)
    )


def trend(signals: DataFrame) -> DataFrame:
    """Trend per series, without a forecast."""
    return _summary(_shape(signals), half_pct(), F.array().cast("array<double>")).drop("forecast")


def linear_forecast(signals: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Endpoint-slope forecast; its percentage is last against first."""
    return _summary(
        _shape(signals), pct_change(F.col("last"), F.col("first")), endpoint_forecast(periods)
    )


def ols_forecast(signals: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Least-squares line over the week index of each series."""
    w = Window.partitionBy(*SERIES).orderBy("week_key")
    fit = (
        weekly_series(signals)
        .withColumn("i", F.row_number().over(w).cast("double"))
        .withColumn("y", amount(F.col("spend")))
        .groupBy(*SERIES)
        .agg(
            F.count("*").alias("n_weeks"),
            F.regr_slope("y", "i").alias("slope"),
            F.regr_intercept("y", "i").alias("intercept"),
        )
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.lit(periods)),
        lambda k: clamp_round(F.col("intercept") + F.col("slope") * (F.col("n_weeks") + k)),
    )
    empty = F.array().cast("array<double>")
    return fit.select(
        *SERIES, "n_weeks", "slope",
        F.when(F.col("n_weeks") >= MIN_POINTS, steps).otherwise(empty).alias("forecast"),
    )


def history_guard(signals: DataFrame, min_weeks: int = 8) -> DataFrame:
    """Which series and brands have enough history to be modelled. No key is dropped."""
    series = weekly_series(signals).groupBy(*SERIES).agg(F.count("*").alias("n_weeks"))
    brands = signals.groupBy("brand").agg(F.count_distinct("week_key").alias("brand_weeks"))
    return series.join(brands, "brand").select(
        *SERIES, "n_weeks", "brand_weeks",
        (F.col("n_weeks") >= MIN_POINTS).alias("can_forecast"),
        (F.col("brand_weeks") >= min_weeks).alias("can_score"),
    )


def fill_weeks(signals: DataFrame) -> DataFrame:
    """The weekly series (brand, channel, week_key, spend) with the weeks between a series' ends that have no rows, at 0.

    The other operators take the weeks that are present; this is for those who want all of them.
    """
    series = weekly_series(signals)
    monday = week_monday(F.col("week_key"))
    ends = series.groupBy(*SERIES).agg(F.min(monday).alias("a"), F.max(monday).alias("b")).filter("a is not null")
    days = F.explode(F.expr("sequence(a, b, interval 7 days)"))
    grid = ends.select(*SERIES, days.alias("monday")).select(*SERIES, iso_week_key(F.col("monday")).alias("week_key"))
    spend = F.coalesce(amount(F.col("spend")), F.lit(0.0))
    return grid.join(series, [*SERIES, "week_key"], "left").select(*SERIES, "week_key", spend.alias("spend"))


def week_ranks(signals: DataFrame) -> DataFrame:
    """Every week of every brand, newest first: brand, week_key, recency (1 = newest)."""
    w = Window.partitionBy("brand").orderBy(F.desc("week_key"))
    weeks = signals.select("brand", "week_key").distinct()
    return weeks.withColumn("recency", F.row_number().over(w))


def recent_weeks(signals: DataFrame, n: int) -> DataFrame:
    """Rows of each brand's last n weeks present."""
    w = Window.partitionBy("brand").orderBy(F.desc("week_key"))
    return signals.withColumn("_wk", F.dense_rank().over(w)).filter(F.col("_wk") <= n).drop("_wk")


def week_days(signals: DataFrame) -> DataFrame:
    """Each week key with its Monday; the original key is carried, never re-made."""
    return signals.select("week_key").distinct().withColumn("monday", week_monday(F.col("week_key")))
