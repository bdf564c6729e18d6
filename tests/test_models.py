"""Fitted models, anomaly flags, summary and briefs."""

import math
import random

import numpy as np
import pytest
from conftest import weeks
from pyspark.sql import functions as F

from spendtide.operators import anomaly, brief, forecast, summary
from spendtide.plans.briefs import saved_briefs
from spendtide.session import shared_dir


def history(n, brand="acme", seed=0, spike=None, channels=("display", "video", "social")):
    rng = random.Random(seed)
    rows = []
    for i, w in enumerate(weeks(n)):
        for ch in channels:
            factor = 20 if i == spike else 1
            rows.append(dict(
                brand=brand, channel=ch, week_key=w, ad_count=rng.randint(10, 100), active_ad_count=rng.randint(5, 50) * factor,
                impression_upper_sum=rng.randint(1_000_000, 5_000_000) * factor, spend_midpoint=rng.uniform(5000, 30000) * factor,
                channel_share=rng.uniform(0.1, 0.5), top_ctas=["Shop Now"], top_themes=["performance", "life\u200bstyle"],
            ))
    return rows


# ---- trend model ----------------------------------------------------------------------


def test_line_is_continued():
    days = np.arange(20) * 7.0
    got = forecast.fit_trend(days, 100 + 3 * days, days[-1] + np.array([7.0, 14.0]))
    assert got == pytest.approx(100 + 3 * (days[-1] + np.array([7.0, 14.0])), rel=0.01)


def test_change_of_slope_is_followed():
    t = np.arange(60.0)
    y = np.where(t < 30, 10 * t, 300 - 5 * (t - 30)) + 500
    got = forecast.fit_trend(t * 7, y, np.array([60 * 7.0]))
    assert got[0] == pytest.approx(500 + 300 - 5 * 30, rel=0.05)


def test_noise_is_smoothed():
    rng = np.random.default_rng(1)
    t = np.arange(40.0)
    got = forecast.fit_trend(t, 1000 + 20 * t + rng.normal(0, 80, 40), t)
    assert np.abs(got - (1000 + 20 * t)).mean() < 60


@pytest.mark.parametrize("seed", range(20))
def test_sparse_mode_meets_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, 60)
    x = np.column_stack([np.ones(60), t, np.maximum(0, t[:, None] - t[1:48:2])])
    a, rhs = x.T @ x + np.diag([1e-3, 1e-3] + [0] * 24), x.T @ (np.cumsum(rng.normal(0, 0.1, 60)) + 1)
    cost = np.array([0.0, 0.0] + [10 ** rng.uniform(-4, 0)] * 24)
    theta = forecast._sparse_mode(a, rhs, cost, np.zeros(26))
    slope = a @ theta - rhs
    on = theta != 0
    assert np.abs(slope[on] + cost[on] * np.sign(theta[on])).max() < 1e-6
    assert (np.abs(slope[~on]) <= cost[~on] + 1e-6).all()


def test_a_fit_that_is_cut_short_says_so(monkeypatch, signals):
    rng = np.random.default_rng(4)
    days, y = np.arange(60) * 7.0, 100 + np.cumsum(rng.normal(0, 30, 60))
    assert forecast.fit_trend_checked(days, y, days[-1:])[1] is True
    monkeypatch.setattr(forecast, "FIT_ROUNDS", 1)
    assert forecast.fit_trend_checked(days, y, days[-1:])[1] is False
    monkeypatch.undo()
    got = {r.brand: r.converged for r in forecast.trend_forecast(signals(history(20) + history(3, "tiny"))).collect()}
    assert got == {"acme": True, "tiny": None}


def test_constant_zero_and_short_series():
    assert forecast.fit_trend(np.arange(4.0), np.zeros(4), np.array([5.0])) == pytest.approx([0.0])
    assert forecast.fit_trend(np.arange(5) * 7.0, np.full(5, 9.0), np.array([40.0])) == pytest.approx([9.0], rel=1e-2)


def test_trend_forecast_rows(signals):
    s = signals(history(20) + history(3, "tiny"))
    got = {(r.brand, r.channel): r for r in forecast.trend_forecast(s).collect()}
    assert len(got) == 6
    for (b, _), r in got.items():
        assert r.trend_direction in ("increasing", "decreasing", "flat")
        assert len(r.forecast) == (4 if b == "acme" else 0)
        assert all(v >= 0 for v in r.forecast)
        assert len(r.weekly_actuals) <= 12
    assert got[("tiny", "video")].trend_pct_change == 0.0


# ---- anomalies ------------------------------------------------------------------------


@pytest.mark.parametrize("detect", [anomaly.isolation_scores, anomaly.robust_anomaly])
def test_number_of_flags_and_planted_week(signals, detect):
    data = []
    for b, n in (("a", 20), ("b", 8), ("c", 45)):
        data += history(n, b, seed=n, spike=n // 2)
    flags = detect(signals(data)).collect()
    for b, n in (("a", 20), ("b", 8), ("c", 45)):
        mine = [r for r in flags if r.brand == b]
        assert len(mine) == n
        hit = [r.week_key for r in mine if r.is_anomaly]
        assert len(hit) == math.ceil(0.15 * (n - 1))
        assert weeks(n)[n // 2] in hit


def test_too_few_weeks(signals):
    flags = anomaly.isolation_scores(signals(history(7)))
    r = anomaly.anomaly_result(flags).first()
    assert (r.anomaly_weeks, r.anomaly_scores, r.n_anomalies) == ([], {}, 0)
    assert r.features_used == anomaly.FEATURES


def test_result_per_brand(signals):
    r = anomaly.anomaly_result(anomaly.isolation_scores(signals(history(20)))).first()
    assert r.n_anomalies == len(r.anomaly_weeks) == 3
    assert r.anomaly_weeks == sorted(r.anomaly_weeks)
    assert set(r.anomaly_weeks) <= set(r.anomaly_scores) == set(weeks(20))


def test_scores_are_repeatable(signals):
    s = signals(history(30))
    assert sorted(anomaly.isolation_scores(s).collect()) == sorted(anomaly.isolation_scores(s.repartition(5)).collect())


def tree_depth(x, sample, row, limit, rng, depth=0):
    """Plain recursive form of one isolation tree, following one row."""
    if depth >= limit or len(sample) <= 1 or (x[sample].max(0) == x[sample].min(0)).all():
        return depth + anomaly._mean_path(np.array([len(sample)]))[0]
    free = np.flatnonzero(x[sample].max(0) > x[sample].min(0))
    f = rng.choice(free)
    cut = rng.uniform(x[sample, f].min(), x[sample, f].max())
    side = x[sample, f] <= cut
    return tree_depth(x, sample[side] if x[row, f] <= cut else sample[~side], row, limit, rng, depth + 1)


def test_forest_agrees_with_recursive_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    x[7] = [6, -6, 6]
    x[8] = x[9]
    got = anomaly.forest_scores(x, n_trees=2000)
    limit = int(np.ceil(np.log2(40)))
    norm = anomaly._mean_path(np.array([40]))[0]
    for row in (0, 7, 8, 20):
        mean = np.mean([tree_depth(x, np.arange(40), row, limit, rng) for _ in range(2000)])
        assert got[row] == pytest.approx(-(2 ** (-mean / norm)), abs=0.01)
    assert got.argmin() == 7
    assert ((got < 0) & (got >= -1)).all()


def test_sampled_forest():
    x = np.random.default_rng(0).normal(size=(1000, 4))
    x[500] = 9
    got = anomaly.forest_scores(x)
    assert got.argmin() == 500 and np.isfinite(got).all()


def test_constant_features(signals):
    data = [dict(week_key=w, spend_midpoint=5.0) for w in weeks(10)]
    for detect in (anomaly.isolation_scores, anomaly.robust_anomaly):
        assert not any(r.is_anomaly for r in detect(signals(data)).collect())


def test_null_features_count_as_zero(signals):
    data = [dict(week_key=w, spend_midpoint=None, channel_share=None, active_ad_count=None, impression_upper_sum=None) for w in weeks(3)]
    r = anomaly.fill_features(anomaly.brand_weekly_features(signals(data))).first()
    assert (r.spend_midpoint, r.active_ad_count, r.impression_upper_sum, r.channel_share) == (0.0, 0, 0, 0.0)


def test_last_anomalies(signals):
    flags = anomaly.robust_anomaly(signals(history(60)))
    hit = sorted((r.week_key for r in flags.collect() if r.is_anomaly), reverse=True)
    assert [r.week_key for r in anomaly.last_anomalies(flags, 3).orderBy("rank").collect()] == hit[:3]


# ---- summary and briefs ---------------------------------------------------------------


@pytest.fixture(scope="module")
def summed(spark, signals):
    brands = spark.createDataFrame([("acme",), ("zeta",), ("nobody",)], "brand string")
    s = signals(history(20) + history(2, "zeta", 3))
    return summary.signal_summary(s, brands=brands).cache()


def test_summary(summed):
    rows = {r.brand: r for r in summed.collect()}
    a, z, none = rows["acme"], rows["zeta"], rows["nobody"]
    assert (none.status, none.dominant_trend, none.weeks_analysed) == ("no_data", None, None)
    assert (a.status, a.weeks_analysed, a.n_anomalies) == ("ok", 20, 3)
    assert a.recent_weeks == weeks(20)[-4:]
    assert sum(a.channel_mix_pct.values()) == pytest.approx(100, abs=0.2)
    assert sorted(a.weekly_deltas) == weeks(20)[-8:]
    assert set(a.channel_forecasts) == {"display", "video", "social"}
    assert len(a.channel_forecasts["video"].forecast) == 4
    assert a.top_themes == ["life\u200bstyle", "performance"]
    assert (z.dominant_trend, z.n_anomalies, z.anomaly_weeks) == ("flat", 0, [])


def test_summary_of_a_channel_list(signals):
    s = signals(history(20))
    r = summary.signal_summary(s, ["video", "radio"], forecaster="linear", detector="robust").first()
    assert set(r.channel_forecasts) == {"video", "radio"}
    assert (r.channel_forecasts["radio"].trend_direction, r.channel_forecasts["radio"].forecast) == ("flat", [])
    assert set(r.channel_mix_pct) == {"video"}
    assert summary.signal_summary(s, [], forecaster="linear", detector="robust").first().status == "no_data"


def test_context(summed):
    rows = {r.brand: r for r in brief.brief_context(summed).collect()}
    a = rows["acme"]
    assert "ACME" in a.prompt and "BRIEF REQUIREMENTS" in a.prompt and a.context in a.prompt
    assert "SIGNAL DATA (20 weeks of observations)" in a.context
    assert "Channel mix" in a.context and "\u200b" not in a.context and "lifestyle" in a.context
    assert "none detected" in rows["zeta"].context
    assert (rows["nobody"].context, rows["nobody"].prompt) == ("Insufficient data for nobody: no_data", None)
    asked = brief.brief_context(summed, "Tell of %s!", "short").filter("brand = 'acme'").first().prompt
    assert asked.startswith("Tell of ACME!") and asked.endswith("BRIEF REQUIREMENTS: short")


def test_last_three_anomalies_in_order(spark):
    df = spark.createDataFrame([(1, list("abcde")), (2, ["a"]), (3, [])], "i int, w array<string>")
    got = [r.t for r in df.select("i", brief.last_weeks_text(F.col("w")).alias("t")).orderBy("i").collect()]
    assert got == ["c, d, e", "a", ""]


def test_mix_text(spark):
    df = spark.createDataFrame([({"b": 40.0, "a": 40.0, "c": 20.0},)], "m map<string,double>")
    assert df.select(brief.mix_text(F.col("m"))).first()[0] == "a: 40.0%, b: 40.0%, c: 20.0%"


def test_briefs(summed):
    def writer(prompt, role):
        if "ZETA" in prompt:
            raise RuntimeError("down")
        return "  A brief.\n"

    briefs = brief.generate_briefs(brief.brief_context(summed), writer)
    got = {r.brand: r.brief for r in briefs.collect()}
    assert got == {"acme": "A brief.", "zeta": "[LLM Error: down]", "nobody": "Insufficient data for nobody: no_data"}
    rows = {r.brand: r for r in brief.brief_response(summed, briefs).collect()}
    assert set(rows) == {"acme", "zeta"}
    assert rows["acme"].brief == "A brief." and rows["acme"].weeks_analysed == 20
    assert rows["zeta"].anomaly_weeks == []


def test_saved_briefs(spark, summed):
    path = shared_dir(spark, "briefs")

    def says(text):
        return lambda prompt, role: text

    def briefs(df):
        return {r.brand: r.brief for r in df.collect()}

    only_acme = summed.filter("brand = 'acme'")
    assert briefs(saved_briefs(only_acme, path, 1, says("one"))) == {"acme": "one"}
    assert briefs(saved_briefs(summed, path, 1, says("two"))) == {"acme": "one", "zeta": "two"}
    assert briefs(saved_briefs(summed, path, 1, says("three"), refresh=True)) == {"acme": "three", "zeta": "three"}
    assert briefs(saved_briefs(only_acme, path, 2, says("four"))) == {"acme": "four"}


def test_a_crash_does_not_ask_again_for_what_is_answered(spark, summed, tmp_path):
    """The writer's process dies over one brand when the other is answered; over two runs the other is asked for once."""
    calls, path = tmp_path / "calls", str(tmp_path / "briefs")
    calls.mkdir()

    def writer(prompt, role):
        import time
        import uuid

        if "ZETA" in prompt and not (tmp_path / "died").exists():
            for _ in range(150):
                if [p for p in (tmp_path / "briefs_answers").rglob("*") if p.is_file() and not p.name.startswith("_")]:
                    break
                time.sleep(0.1)
            (tmp_path / "died").touch()
            raise SystemExit("gone")  # no Exception: the task goes with it
        name = "acme" if "ACME" in prompt else "zeta"
        (calls / f"{name}-{uuid.uuid4().hex}").touch()
        return f" text of {name} "

    def run():
        return saved_briefs(summed, path, 1, writer, task="On %s", attempts=1, parallel=1)

    with pytest.raises(Exception):  # noqa: B017
        run()
    assert (tmp_path / "died").exists()
    assert {r.brand: r.brief for r in run().collect()} == {"acme": "text of acme", "zeta": "text of zeta"}
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["acme", "zeta"]
    assert not (tmp_path / "briefs_answers" / "snapshot_id=1" / "run=0").exists()


def test_failed_calls_are_tried_again_and_not_kept(spark, summed, tmp_path):
    def flaky(prompt, role):
        mark = tmp_path / ("a" if "ACME" in prompt else "z")
        tries = len(mark.read_text()) if mark.exists() else 0
        mark.write_text("x" * (tries + 1))
        if "ACME" in prompt and tries < 2 or "ZETA" in prompt and tries < 4:
            raise ValueError("busy")
        return "done"

    contexts = brief.brief_context(summed, "On %s")
    def run():
        out = brief.answered_briefs(contexts, str(tmp_path / "answers"), flaky, attempts=3, pause=0.01)
        return {r.brand: r.brief for r in out.collect() if r.brand in ("acme", "zeta")}

    assert run() == {"acme": "done", "zeta": "[LLM Error: busy]"}
    assert run() == {"acme": "done", "zeta": "done"}
    assert (len((tmp_path / "a").read_text()), len((tmp_path / "z").read_text())) == (3, 5)
