"""Additive trend forecast per brand and channel.

The model is the piecewise-linear trend of Taylor & Letham (2018) with all
seasonal parts off: slope changes at fixed change points, a Laplace prior on each
change, normal priors on slope and offset. The fit alternates between the noise
level and the mode for it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.functions.calendar import week_monday
from spendtide.functions.numbers import amount
from spendtide.operators.trend import (
    MIN_POINTS, PERIODS, SERIES, _shape, _summary, half_pct, weekly_series,
)
from spendtide.session import task_count

# Priors, change points, and the day the first step lands on.
CHANGE_POINTS = 25
CHANGE_RANGE = 0.8
CHANGE_SCALE = 0.1
OFFSET_SCALE = 5.0
NOISE_SCALE = 0.5
FIRST_STEP_DAYS = 6   # the Sunday after the last Monday
STEP_DAYS = 7


# Rounds of the search per coordinate, and of the whole fit, after which it is given up as not converged.
SEARCH_ROUNDS = 20
FIT_ROUNDS = 50


def _sparse_mode(a: np.ndarray, rhs: np.ndarray, cost: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return _sparse_search(a, rhs, cost, theta)[0]


def _sparse_search(a: np.ndarray, rhs: np.ndarray, cost: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, bool]:
    """Minimum of theta' a theta / 2 - rhs theta + sum(cost |theta|), from a start.

    Feature-sign search (Lee et al., 2006): solve for the coordinates in use with
    their signs held, stop at the best sign change on the way, then let in the
    coordinate that gains most. Each round is one small linear solve. Also tells whether it ended at the minimum.
    """
    def value(t: np.ndarray) -> float:
        return t @ a @ t / 2 - rhs @ t + cost @ np.abs(t)

    free = cost == 0
    sign = np.where(free, 0.0, np.sign(theta))
    used = free | (sign != 0)
    for _ in range(SEARCH_ROUNDS * len(theta)):
        at = np.flatnonzero(used)
        goal = np.zeros_like(theta)
        goal[at] = np.linalg.solve(a[np.ix_(at, at)], rhs[at] - cost[at] * sign[at])
        step = goal - theta
        turns = used & ~free & (theta != 0) & (np.sign(goal) != sign)
        stops = [goal]
        for j in np.flatnonzero(turns):
            stop = theta - step * (theta[j] / step[j])
            stop[j] = 0.0
            stops.append(stop)
        best = int(np.argmin([value(s) for s in stops]))
        theta = stops[best]
        sign = np.where(free, 0.0, np.sign(theta))
        used = free | (sign != 0)
        if best == 0:
            slope = a @ theta - rhs
            gain = np.where(used, -np.inf, np.abs(slope) - cost)
            j = int(gain.argmax())
            if gain[j] <= 1e-9:
                return theta, True
            used[j], sign[j] = True, -np.sign(slope[j])
    return theta, False


def fit_trend(days: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Trend values on the days `ahead`, fitted on (days, y) sorted by day."""
    return fit_trend_checked(days, y, ahead)[0]


def fit_trend_checked(days: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, bool]:
    """The same, and whether the fit converged within its rounds."""
    scale = np.abs(y).max() or 1.0
    span = float(days[-1] - days[0]) or 1.0
    t, z = (days - days[0]) / span, y / scale
    hist = int(np.floor(len(t) * CHANGE_RANGE))
    n_cp = min(CHANGE_POINTS, hist - 1)
    at = np.round(np.linspace(0, hist - 1, n_cp + 1)).astype(int)[1:] if n_cp > 0 else np.array([], int)
    knots = t[at]

    def design(u: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones_like(u), u, np.maximum(0.0, u[:, None] - knots)])

    a = design(t)
    gram, rhs, power = a.T @ a, a.T @ z, z @ z
    theta = np.zeros(a.shape[1])
    theta[0], theta[1] = z[0], z[-1] - z[0]
    smooth = np.arange(len(theta)) < 2
    sigma2 = max(np.var(z - a @ theta), 1e-4)
    converged = False
    for _ in range(FIT_ROUNDS):
        before = theta
        # Ridge on offset and slope, absolute cost on changes, both in units of the noise.
        ridge = np.diag(np.where(smooth, sigma2 / OFFSET_SCALE**2, 0.0))
        cost = np.where(smooth, 0.0, sigma2 / CHANGE_SCALE)
        theta, found = _sparse_search(gram + ridge, rhs, cost, theta.copy())
        rss = max(power - 2 * theta @ rhs + theta @ gram @ theta, 0.0)
        # Mode of the noise variance under a half-normal prior.
        n, s2 = len(z), NOISE_SCALE**2
        sigma2 = max((-n * s2 + np.sqrt((n * s2) ** 2 + 4 * s2 * rss)) / 2, 1e-8)
        if found and np.abs(theta - before).max() < 1e-6:
            converged = True
            break
    return design((ahead - days[0]) / span) @ theta * scale, converged


def _forecaster(periods: int):
    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("day")
        out = series[SERIES].head(1).copy()
        values: list[float] = []
        converged = None
        if len(series) >= MIN_POINTS:
            days = series["day"].to_numpy(dtype=float)
            ahead = days[-1] + FIRST_STEP_DAYS + STEP_DAYS * np.arange(periods)
            fitted, converged = fit_trend_checked(days, series["y"].to_numpy(float), ahead)
            values = [round(max(0.0, float(v)), 2) for v in fitted]
        out["forecast"] = [values]
        out["converged"] = pd.array([converged], dtype="boolean")
        return out

    return run


def trend_forecast(signals: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Trend, forecast and last actuals for every brand and channel in one job.

    `converged` is false where the fit was given up, null where there was nothing to fit.
    """
    series = weekly_series(signals).select(
        *SERIES,
        F.unix_date(week_monday(F.col("week_key"))).alias("day"),
        amount(F.col("spend")).alias("y"),
    ).repartition(task_count(signals.sparkSession), *SERIES)
    fitted = series.groupBy(*SERIES).applyInPandas(
        _forecaster(periods), "brand string, channel string, forecast array<double>, converged boolean"
    )
    shape = _shape(signals).join(fitted, SERIES)
    return _summary(shape, half_pct(), F.col("forecast"), "converged")
