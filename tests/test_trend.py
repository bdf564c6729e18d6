"""Trend, forecasts, reports and the edge cases of time order."""

import pytest
from conftest import weeks

from spendtide.operators import report, trend


def series(ys, channel="social", brand="acme", region="US"):
    return [dict(brand=brand, channel=channel, region=region, week_key=w, spend_midpoint=float(y)) for w, y in zip(weeks(len(ys)), ys)]


def rows(df):
    return {(r.brand, r.channel): r for r in df.collect()}


def test_falling_spend_is_clamped(signals):
    r = rows(trend.linear_forecast(signals(series([19, 16, 13, 10]))))[("acme", "social")]
    assert r.forecast == [7.0, 4.0, 1.0, 0.0]
    assert r.trend_direction == "decreasing"


def test_short_history_keeps_its_row(signals):
    for f in (trend.linear_forecast, trend.ols_forecast):
        assert rows(f(signals(series([1000]))))[("acme", "social")].forecast == []
    r = rows(trend.trend(signals(series([1, 50, 900]))))[("acme", "social")]
    assert (r.trend_direction, r.trend_pct_change, r.weekly_actuals, r.weekly_dates) == ("flat", 0.0, [], [])


@pytest.mark.parametrize("last,want", [(110.0, "flat"), (90.0, "flat"), (110.01, "increasing"), (89.99, "decreasing")])
def test_limits_are_strict(signals, last, want):
    r = rows(trend.trend(signals(series([100, 100, 100, last]))))[("acme", "social")]
    assert r.trend_direction == want


def test_eight_weeks_compare_halves(signals):
    r = rows(trend.trend(signals(series([5, 10, 10, 10, 10, 20, 20, 20, 20]))))[("acme", "social")]
    assert (r.trend_pct_change, r.trend_direction, r.n_weeks) == (100.0, "increasing", 9)


def test_seven_weeks_compare_ends(signals):
    assert rows(trend.trend(signals(series([10, 0, 0, 0, 0, 0, 15]))))[("acme", "social")].trend_pct_change == 50.0


def test_regions_are_summed_first(signals):
    us, uk = series(range(1, 10)), series(range(1, 10), region="UK")
    both = rows(trend.trend(signals(us + uk)))[("acme", "social")]
    double = rows(trend.trend(signals(series([2 * y for y in range(1, 10)]))))[("acme", "social")]
    single = rows(trend.trend(signals(us)))[("acme", "social")]
    assert both == double
    assert both.trend_pct_change == single.trend_pct_change
    assert both.n_weeks == 9


def test_at_most_twelve_actuals_with_their_keys(signals):
    r = rows(trend.trend(signals(series(range(60)))))[("acme", "social")]
    assert r.weekly_actuals == [float(y) for y in range(48, 60)]
    assert r.weekly_dates == weeks(60)[-12:]


def test_ols_continues_a_line(signals):
    r = rows(trend.ols_forecast(signals(series([3 + 2 * i for i in range(10)]))))[("acme", "social")]
    assert r.forecast == [23.0, 25.0, 27.0, 29.0]


def test_null_spend_counts_as_zero(signals):
    data = series([10, 10, 10, 10])
    data[1]["spend_midpoint"] = None
    assert rows(trend.linear_forecast(signals(data)))[("acme", "social")].weekly_actuals == [10.0, 0.0, 10.0, 10.0]


def test_wow_uses_the_previous_week_present(signals):
    data = series([100, 0, 0, 150])
    data = [data[0], data[3]]
    r = report.wow_delta(signals(data)).first()
    assert (r.spend_pct, r.ads_pct) == (50.0, 0.0)


def test_wow_without_a_base_is_null(signals):
    assert report.wow_delta(signals(series([0, 5]))).first().spend_pct is None
    assert report.wow_delta(signals(series([5]))).first().spend_pct is None


def test_dominant_tie_goes_to_first_channel(signals):
    up, down = [10, 10, 10, 10, 20, 20, 20, 20], [20, 20, 20, 20, 10, 10, 10, 10]
    data = series(up, "video") + series(down, "social")
    assert report.dominant_trend(signals(data)).first().dominant_trend == "decreasing"
    data = series(up, "social") + series(down, "video")
    assert report.dominant_trend(signals(data)).first().dominant_trend == "increasing"


def test_mix_of_recent_weeks(signals):
    data = series([1000, 1, 1, 1, 1]) + series([0, 3, 3, 3, 3], "video")
    mix = {r.channel: (r.spend, r.pct, r["rank"]) for r in report.mix_desc(signals(data)).collect()}
    assert mix == {"video": (12.0, 75.0, 1), "social": (4.0, 25.0, 2)}
    zero = report.channel_mix(signals(series([0, 0]))).first()
    assert (zero.spend, zero.pct) == (0.0, 0.0)


def test_single_week(signals):
    data = [dict(week_key="2024-W01", spend_midpoint=100.0), dict(week_key="2024-W01", channel="video", spend_midpoint=50.0)]
    assert [(r.channel, r.spend) for r in report.trend_series(signals(data)).orderBy("channel").collect()] == [("social", 100.0), ("video", 50.0)]
    wide = report.trend_wide(signals(data), ["social", "video", "tv"]).first()
    assert (wide.social, wide.video, wide.tv) == (100.0, 50.0, None)


def test_totals_and_tail(signals):
    s = signals(series(range(1, 11)) + series(range(1, 11), "video"))
    want = {w: 2.0 * y for w, y in zip(weeks(10)[2:], range(3, 11))}
    assert {r.week_key: r.spend for r in report.weekly_totals(s).collect()} == want
    assert [(r.week_key, r.spend) for r in report.tail_weeks(s, "acme").collect()] == sorted(want.items(), reverse=True)


def test_kpis_of_a_brand_without_rows(spark, signals):
    brands = spark.createDataFrame([("acme",), ("nobody",)], "brand string")
    got = {r.brand: tuple(r)[1:] for r in report.kpis(signals(series([1, 2])), brands).collect()}
    assert got == {"acme": (3.0, 2, 2, 1), "nobody": (0.0, 0, 0, 0)}


def test_themes_by_rows_then_name(signals):
    data = [dict(week_key=w, top_themes=t) for w, t in zip(weeks(4), [["b", "a"], ["b", "c"], ["a"], None])]
    got = [(r.theme, r.n_rows) for r in report.brand_top_themes(signals(data)).orderBy("rank").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 1)]


def test_signals_page(signals):
    s = signals(series(range(30)) + series(range(30), "video"))
    page = report.signals_query(s, "ACME", limit=3).collect()
    assert [(r.week_key, r.channel) for r in page] == [(weeks(30)[29], "social"), (weeks(30)[29], "video"), (weeks(30)[28], "social")]
    assert report.signals_query(s, "acme", "video").count() == 30
    assert report.signals_query(s, "nobody").count() == 0
    assert report.signals_query(s, "acme").columns == ["brand", "channel", "week_key", "spend_midpoint", "ad_count", "channel_share"]
    with pytest.raises(ValueError):
        report.signals_query(s, "acme", limit=1001)


def test_weeks_without_rows_are_filled(signals):
    w = weeks(6)
    s = signals([dict(week_key=w[0], spend_midpoint=5.0), dict(week_key=w[4], spend_midpoint=7.0), dict(channel="tv", week_key=w[2])])
    got = sorted((r.channel, r.week_key, r.spend) for r in trend.fill_weeks(s).collect())
    assert got == [("social", k, 5.0 if i == 0 else 7.0 if i == 4 else 0.0) for i, k in enumerate(w[:5])] + [("tv", w[2], 0.0)]
