"""Fixed-width fractional differencing and the stationarity search for its order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import series

FOUND = "ticker string, d double, p_value double, adf_stat double"


def ffd_weights(d: float, tau: float = 1e-4, most: int = 100_000) -> list[float]:
    """Binomial weights of (1 - L)^d, newest first, up to the first below ``tau``."""
    w = [1.0]
    while len(w) < most:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < tau:
            break
        w.append(nxt)
    return w


def ffd(df: DataFrame, d: float, x: str = "c", tau: float = 1e-4, out: str = "fracdiff") -> DataFrame:
    """The weighted sum over the last values of each ticker; nulls are taken out first, so gaps close."""
    w = ffd_weights(d, tau)
    oldest = F.array(*[F.lit(v) for v in reversed(w)])
    frame = F.collect_list(x).over(series().rowsBetween(-(len(w) - 1), 0))
    rows = df.where(F.col(x).isNotNull()).withColumn("__f", frame)
    total = F.aggregate(F.zip_with("__f", oldest, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn(out, F.when(F.size("__f") == len(w), total)).drop("__f")


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


# MacKinnon's response surface for the test with a constant and one series.
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def adf(x: np.ndarray) -> tuple[float, float]:
    """(p, statistic) of the augmented Dickey-Fuller test with a constant; the lag has the least AIC."""
    n = len(x)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    dx = np.diff(x)

    def fit(lags: int, skip: int):
        y = dx[skip:]
        cols = [x[skip:-1], *[dx[skip - k : len(dx) - k] for k in range(1, lags + 1)], np.ones(len(y))]
        m = np.stack(cols, 1)
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        res = y - m @ beta
        return m, beta, float(res @ res), len(y)

    def aic(lags: int) -> float:
        m, _, rss, k = fit(lags, most)
        return k * math.log(max(rss, 1e-300) / k) + 2 * m.shape[1]

    lags = min(range(most + 1), key=aic)
    m, beta, rss, k = fit(lags, lags)
    cov = np.linalg.pinv(m.T @ m) * rss / max(1, k - m.shape[1])
    stat = float(beta[0] / math.sqrt(cov[0, 0])) if cov[0, 0] > 0 else 0.0
    if stat > TAU_MAX:
        return 1.0, stat
    if stat < TAU_MIN:
        return 0.0, stat
    poly = SMALL_P if stat <= TAU_STAR else LARGE_P
    return normal_cdf(sum(c * stat**i for i, c in enumerate(poly))), stat


def is_stationary(x: np.ndarray, level: float = 0.05) -> tuple[bool, float, float]:
    """(verdict, p, statistic); fewer than 30 values, or constant ones, are not stationary."""
    if len(x) < 30 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return False, 1.0, 0.0
    p, stat = adf(x)
    return p < level, p, stat


def best_order(x: np.ndarray, tau: float = 1e-4, level: float = 0.05) -> tuple[float, float, float]:
    """(d, p, statistic): the least order that makes a series stationary, by tenths and then by hundredths below."""
    def test(d: float):
        w = np.array(ffd_weights(d, tau))
        return is_stationary(np.correlate(x, w[::-1], "valid"), level) if len(x) >= len(w) else (False, 1.0, 0.0)

    ok, p, stat = is_stationary(x, level)
    if ok:
        return 0.0, p, stat
    for k in range(1, 11):
        ok, p, stat = test(k / 10)
        if ok:
            for j in range(9, 0, -1):
                d = round(k / 10 - j / 100, 2)
                fine = test(d) if d > 0 else (False, 1.0, 0.0)
                if fine[0]:
                    return d, fine[1], fine[2]
            return k / 10, p, stat
    return 1.0, p, stat


def optimal_orders(df: DataFrame, x: str = "c", tau: float = 1e-4, level: float = 0.05) -> DataFrame:
    """(ticker, d, p_value, adf_stat); a ticker has as many rows as the calendar has dates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        v = pdf[x].dropna().to_numpy(np.float64)
        d, p, stat = best_order(v, tau, level)
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "d": [d], "p_value": [p], "adf_stat": [stat]})

    return df.select("ticker", "ts", x).groupBy("ticker").applyInPandas(run, FOUND)


def ffd_by_order(df: DataFrame, orders: DataFrame, x: str = "c", tau: float = 1e-4) -> DataFrame:
    """Every ticker differenced at its own order: (ticker, ts, fracdiff)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        v, w = pdf[x].to_numpy(np.float64), np.array(ffd_weights(float(pdf["d"].iloc[0]), tau))
        out = np.full(len(v), np.nan)
        if len(v) >= len(w):
            out[len(w) - 1 :] = np.correlate(v, w[::-1], "valid")
        return pd.DataFrame({"ticker": pdf["ticker"], "ts": pdf["ts"], "fracdiff": out})

    rows = df.where(F.col(x).isNotNull()).select("ticker", "ts", x).join(orders.select("ticker", "d"), "ticker")
    return rows.groupBy("ticker").applyInPandas(run, "ticker string, ts date, fracdiff double")
