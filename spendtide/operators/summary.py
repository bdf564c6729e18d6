"""One summary row per brand, assembled from the reports.

Each part is grouped by brand, so the joins line up on that key. Lists and maps
are bounded by channels and weeks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtide.operators.anomaly import isolation_scores, robust_anomaly
from spendtide.operators.clean import filter_brand_channels
from spendtide.operators.forecast import trend_forecast
from spendtide.operators.report import MIX_WEEKS, TOTAL_WEEKS, brand_top_themes, channel_mix
from spendtide.operators.trend import linear_forecast

FORECASTERS = {"trend": trend_forecast, "linear": linear_forecast}
DETECTORS = {"forest": isolation_scores, "robust": robust_anomaly}


def _channel_part(forecasts: DataFrame) -> DataFrame:
    """Forecast details by channel, and the most common direction among them."""
    details = F.struct(*[c for c in forecasts.columns if c not in ("brand", "channel")])
    entry = F.struct("channel", details.alias("details"))

    def votes(e, i):
        way = e["details"]["trend_direction"]
        same = F.size(F.filter(F.col("entries"), lambda x: x["details"]["trend_direction"] == way))
        return F.struct(same.alias("n"), (-i).alias("early"), way.alias("way"))

    per_brand = forecasts.groupBy("brand").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return per_brand.select(
        "brand",
        F.map_from_entries("entries").alias("channel_forecasts"),
        F.array_max(F.transform("entries", votes))["way"].alias("dominant_trend"),
    )


def _week_part(flags: DataFrame) -> DataFrame:
    """Everything that reads a brand's weeks: totals, flags, scores, newest weeks.

    The flags carry the weekly spend, so the weeks are aggregated only once.
    """
    newest = Window.partitionBy("brand").orderBy(F.desc("week_key"))
    recency = F.col("recency")

    def listed(keep: Column, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(keep, value)))

    week = F.col("week_key")
    return flags.withColumn("recency", F.row_number().over(newest)).groupBy("brand").agg(
        F.count("*").alias("weeks_analysed"),
        F.map_from_entries(listed(recency <= TOTAL_WEEKS, F.struct("week_key", "spend_midpoint"))).alias("weekly_deltas"),
        listed(recency <= MIX_WEEKS, week).alias("recent_weeks"),
        listed(F.col("is_anomaly"), week).alias("anomaly_weeks"),
        F.map_from_entries(listed(F.col("score").isNotNull(), F.struct("week_key", "score"))).alias("anomaly_scores"),
        F.count_if("is_anomaly").alias("n_anomalies"),
    )


def forecast_all(signals: DataFrame, channels: list[str] | None = None, forecaster: str = "trend") -> DataFrame:
    """Forecast rows of every brand. A channel asked for but absent from a brand's
    data keeps a row: flat, no forecast."""
    out = FORECASTERS[forecaster](signals)
    if channels is None:
        return out
    grid = signals.select("brand").distinct().select(
        "brand", F.explode(F.array(*[F.lit(c) for c in sorted(set(channels))])).alias("channel")
    )
    full = grid.join(out, ["brand", "channel"], "left")
    none = {"n_weeks": F.lit(0), "trend_direction": F.lit("flat"), "trend_pct_change": F.lit(0.0), "converged": F.lit(None)}
    filled = []
    for f in out.schema.fields:
        if f.name in ("brand", "channel"):
            filled.append(F.col(f.name))
        else:
            default = none.get(f.name, F.array()).cast(f.dataType)
            filled.append(F.coalesce(f.name, default).alias(f.name))
    return full.select(*filled)


def signal_summary(
    signals: DataFrame,
    channels: list[str] | None = None,
    brands: DataFrame | None = None,
    forecaster: str = "trend",
    detector: str = "forest",
) -> DataFrame:
    """One row per brand; `status` is 'ok' or 'no_data'.

    `brands` (a column `brand`) lists the brands asked for; without it every brand
    of `signals` gets a row. Several parts read `signals`, so pass a written table.
    """
    asked = (signals if brands is None else brands).select("brand").distinct()
    data = filter_brand_channels(signals, channels=channels)

    mix = channel_mix(data).groupBy("brand").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "pct")))).alias("channel_mix_pct")
    )
    themes = brand_top_themes(data).groupBy("brand").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "theme"))), lambda e: e["theme"]).alias("top_themes")
    )
    parts = [
        _week_part(DETECTORS[detector](data)),
        _channel_part(forecast_all(data, channels or None, forecaster)),
        mix,
        themes,
    ]
    out = asked
    for part in parts:
        out = out.join(part, "brand", "left")
    known = F.col("weeks_analysed").isNotNull()
    texts = F.array().cast("array<string>")
    return out.select(
        "brand",
        F.when(known, "ok").otherwise("no_data").alias("status"),
        F.when(known, F.coalesce("dominant_trend", F.lit("flat"))).alias("dominant_trend"),
        "channel_forecasts", "channel_mix_pct", "weekly_deltas", "anomaly_weeks", "anomaly_scores",
        "n_anomalies",
        F.when(known, F.coalesce("top_themes", texts)).alias("top_themes"),
        "weeks_analysed", "recent_weeks",
    )
