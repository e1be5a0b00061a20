"""Expected returns, covariance, optimisation, costs and the walk-forward backtest."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import ratio


def conditional_payoffs(labels: DataFrame, dates: DataFrame, known_by: str = "exit", default: float = 0.05) -> DataFrame:
    """(ts, up, down): mean gain of +1 labels and mean loss of -1 labels known before each date.

    Sums by day are added up over the calendar, so no date meets every label.
    """
    day = F.col("exit_ts" if known_by == "exit" else "ts")
    gain = lambda k, x: F.sum(F.when(F.col("label") == k, x))
    per_day = labels.groupBy(day.alias("ts")).agg(
        gain(1, F.col("ret")).alias("su"), F.count_if(F.col("label") == 1).alias("nu"), gain(-1, -F.col("ret")).alias("sd"), F.count_if(F.col("label") == -1).alias("nd")
    )
    all_days = dates.select("ts").withColumn("wanted", F.lit(True)).unionByName(per_day.select("ts").withColumn("wanted", F.lit(False))).groupBy("ts").agg(F.max("wanted").alias("wanted"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    run = all_days.join(per_day, "ts", "left").select("ts", "wanted", *[F.sum(c).over(w).alias(c) for c in ("su", "nu", "sd", "nd")])
    mean = lambda s, n: F.coalesce(F.col(s) / F.nullif(F.col(n), F.lit(0)), F.lit(default))
    return run.where("wanted").select("ts", mean("su", "nu").alias("up"), mean("sd", "nd").alias("down"))


def expected_returns(predictions: DataFrame, payoffs: DataFrame) -> DataFrame:
    """Direction times its payoff times (2 p - 1); no direction expects nothing."""
    d = F.coalesce(F.col("direction"), F.lit(0))
    pay = F.when(d > 0, F.col("up")).when(d < 0, F.col("down"))
    mu = F.when(d == 0, 0.0).otherwise(F.signum(d.cast("double")) * pay * (2 * F.col("p") - 1))
    return predictions.join(payoffs, "ts").withColumn("mu", F.coalesce(mu, F.lit(0.0)))


BLOCK = 256  # tickers of a block; a task holds the series of two blocks


def series_products(returns: DataFrame, x: str = "ret") -> DataFrame:
    """(a, b, n, na, nb, sx, sy, sxy, s, q) of every two tickers a <= b, from matrix products of blocks of tickers.

    n, sx, sy and sxy are the count and the sums over dates where both have a value, taken off the means of the two. s and q are the
    covariance over all dates (nulls as zero) and the mean product of squared deviations, as shrinkage needs them. na and nb count values. A ticker travels as one array, once for each block.
    """
    rows = returns.select("ticker", "ts", F.col(x).alias("x"))
    dates = rows.select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)  # one row for each date
    days = dates.count()
    blocks = max(1, -(-rows.select("ticker").distinct().count() // BLOCK))
    # The dates of a ticker are a bounded array: a calendar has thousands of them.
    one = rows.where("x IS NOT NULL").join(F.broadcast(dates), "ts").groupBy("ticker").agg(F.collect_list(F.struct("pos", "x")).alias("v"))
    one = rows.select("ticker").distinct().join(one, "ticker", "left").withColumn("block", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = one.withColumn("other", other).select("ticker", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker", kind="stable").reset_index(drop=True)
        m = np.full((len(pdf), days), np.nan)
        for k, v in enumerate(pdf["v"]):
            if v is not None:
                for r in v:
                    m[k, r["pos"]] = r["x"]
        there = ~np.isnan(m)
        count = there.sum(1)
        mean = np.where(count > 0, np.nansum(m, 1) / np.maximum(count, 1), 0)
        off = np.where(there, m - mean[:, None], 0)
        full = np.where(there, m, 0)
        z = full - full.mean(1, keepdims=True)
        w = there.astype(float)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        one, two = np.flatnonzero(pdf["block"] == i), np.flatnonzero(pdf["block"] == j)
        parts = {"n": w[one] @ w[two].T, "sx": off[one] @ w[two].T, "sy": w[one] @ off[two].T, "sxy": off[one] @ off[two].T, "s": z[one] @ z[two].T / days, "q": (z[one] ** 2) @ (z[two] ** 2).T / days}
        names = pdf["ticker"].to_numpy()
        a, b = np.repeat(names[one], len(two)), np.tile(names[two], len(one))
        out = pd.DataFrame({"a": a, "b": b, "na": np.repeat(count[one], len(two)), "nb": np.tile(count[two], len(one)), **{k: v.ravel() for k, v in parts.items()}})
        if i == j:
            return out[out["a"] <= out["b"]]
        turned = out["a"] > out["b"]
        out.loc[turned, ["a", "b", "na", "nb", "sx", "sy"]] = out.loc[turned, ["b", "a", "nb", "na", "sy", "sx"]].to_numpy()
        return out

    schema = "a string, b string, na long, nb long, n double, sx double, sy double, sxy double, s double, q double"
    return dealt.groupBy("i", "j").applyInPandas(run, schema)


def sample_covariance(returns: DataFrame, x: str = "ret") -> DataFrame:
    """(a, b, cov, n) of every two tickers over their common dates."""
    p = series_products(returns, x).where("n > 0")
    return p.select("a", "b", F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("cov"), F.col("n").cast("long").alias("n"))


def shrunk_covariance(returns: DataFrame, x: str = "ret", ridge: float = 1e-6) -> DataFrame:
    """(a, b, sample, ledoit_wolf, oas): covariances over all dates with nulls as zero; the shrinkage follows from two sums over
    all pairs, so no task holds the whole matrix. Tickers without any value take no part in it and get the ridge alone.
    """
    p = series_products(returns, x)
    own, live = F.col("a") == F.col("b"), (F.col("na") > 0) & (F.col("nb") > 0)
    twice = F.when(own, 1).otherwise(2)
    n = returns.select("ts").distinct().count()
    g = p.where(live).agg(F.count_if(own).alias("p"), F.sum(F.when(own, F.col("s"))).alias("trace"), F.sum(twice * F.col("s") ** 2).alias("ss"), F.sum(twice * F.col("q")).alias("qq"))
    mu = F.col("trace") / F.col("p")
    delta = (F.col("ss") - 2 * mu * F.col("trace") + mu * mu * F.col("p")) / F.col("p")
    beta = F.least(delta, (F.col("qq") - F.col("ss")) / (F.col("p") * n))
    alpha, square = F.col("ss") / (F.col("p") * F.col("p")), mu * mu
    den = (n + 1.0) * (alpha - square / F.col("p"))
    g = g.select(mu.alias("mu"), F.when(delta > 0, beta / delta).otherwise(0.0).alias("lw"), F.when(den <= 0, 1.0).otherwise(F.least(F.lit(1.0), (alpha + square) / den)).alias("oas"))
    part = lambda w: F.when(live, (1 - F.col(w)) * F.col("s") + F.when(own, F.col(w) * F.col("mu")).otherwise(0.0)).otherwise(0.0) + F.when(own, ridge).otherwise(0.0)
    return p.join(F.broadcast(g)).select("a", "b", (F.when(live, F.col("s")).otherwise(0.0) + F.when(own, ridge).otherwise(0.0)).alias("sample"), part("lw").alias("ledoit_wolf"), part("oas").alias("oas"))


def covariance(x: np.ndarray, method: str = "ledoit_wolf", least: int = 126, ridge: float = 1e-6) -> np.ndarray:
    """Covariance of (dates, assets). Too few dates give the mean variance times identity, without a ridge and past nulls; else nulls
    are zero, and assets without any value take no part and get the ridge alone.
    """
    if method not in ("sample", "oas", "ledoit_wolf"):
        raise ValueError(f"unknown method {method}")
    x = np.asarray(x, float)
    n, assets = x.shape
    if n < least:
        count = (~np.isnan(x)).sum(0)
        off = np.nan_to_num(x - np.where(count > 0, np.nansum(x, 0) / np.maximum(count, 1), 0)) if n else x
        var = (off**2).sum(0)[count > 1] / (count[count > 1] - 1) if n else np.zeros(0)
        return (float(var.mean()) if len(var) else 1e-4) * np.eye(assets)
    some = ~np.isnan(x).all(0)
    z = np.nan_to_num(x[:, some])
    p = z.shape[1]
    z = z - z.mean(0)
    s = z.T @ z / n
    out = s
    if p and method != "sample":
        mu, total = np.trace(s) / p, (s * s).sum()
        if method == "oas":
            a, b = total / (p * p), mu * mu
            den = (n + 1.0) * (a - b / p)
            part = 1.0 if den <= 0 else min(1.0, (a + b) / den)
        else:
            delta = ((s - mu * np.eye(p)) ** 2).sum() / p
            beta = min(delta, (((z * z).T @ (z * z)).sum() / n - total) / (p * n))
            part = beta / delta if delta > 0 else 0.0
        out = (1 - part) * s + part * mu * np.eye(p)
    full = np.zeros((assets, assets))
    full[np.ix_(some, some)] = out
    return full + ridge * np.eye(assets)


@dataclass
class Limits:
    """What a regime allows."""

    leverage: float = 1.0
    cap: float = 0.10
    cash: float = 0.0
    objective: str = "max_sharpe"


def _ball(v: np.ndarray, r: float) -> np.ndarray:
    """Projection onto the L1 ball of radius r."""
    if np.abs(v).sum() <= r:
        return v
    u = np.sort(np.abs(v))[::-1]
    c = np.cumsum(u) - r
    k = np.nonzero(u * np.arange(1, len(u) + 1) > c)[0][-1]
    return np.sign(v) * np.maximum(np.abs(v) - c[k] / (k + 1), 0)


def optimise(mu: np.ndarray, cov: np.ndarray, now: np.ndarray, limits: Limits, cost: float = 0.005, aversion: float = 2.0, rounds: int = 20_000, tol: float = 1e-8) -> np.ndarray:
    """Weights by consensus ADMM: a quadratic, turnover with box, and budget (with leverage) parts.

    Small weights become zero. Where the parts do not agree, the present weights stay, or equal ones where there are none.
    """
    n = len(mu)
    quad = {"min_variance": 1.0, "risk_parity": 1.0, "max_sharpe": aversion, "return": 0.0}[limits.objective]
    lin = mu if limits.objective in ("max_sharpe", "return") else np.zeros(n)
    low = np.full(n, 0.0 if limits.leverage == 1 else -limits.cap)
    if limits.objective == "risk_parity":
        low = np.full(n, min(0.2 / n, limits.cap))
    top, budget = np.full(n, limits.cap), 1 - limits.cash
    rho = max(1e-3, 2 * quad * float(np.trace(cov)) / n)
    solve = np.linalg.inv(2 * quad * cov + rho * np.eye(n))
    x = np.clip(now, low, top)
    z = [x.copy() for _ in range(3)]
    u = [np.zeros(n) for _ in range(3)]
    for _ in range(rounds):
        z[0] = solve @ (lin + rho * (x - u[0]))
        v = x - u[1] - now
        z[1] = np.clip(now + np.sign(v) * np.maximum(np.abs(v) - cost / rho, 0), low, top)
        v = x - u[2]
        if limits.leverage != 1:
            v = _ball(v, limits.leverage)
        z[2] = v - max(0.0, v.sum() - budget) / n + max(0.0, -v.sum()) / n
        before, x = x, sum(a + b for a, b in zip(z, u, strict=True)) / 3
        for a, b in zip(z, u, strict=True):
            b += a - x
        if max(float(np.abs(a - x).max()) for a in z) < tol and float(np.abs(x - before).max()) < tol:
            break
    else:
        if max(float(np.abs(a - x).max()) for a in z) > 1e-4:
            return now.copy() if np.abs(now).sum() > 0 else np.full(n, 1 / n)
    out = np.clip(z[1], low, top)
    out[np.abs(out) < 1e-4] = 0
    return out


# Basis points of traded value for commission, slippage and the whole spread.
COMMISSION, SLIPPAGE, SPREAD = 1.0, 5.0, 2.0


def transaction_costs(old: DataFrame, new: DataFrame, value: float) -> DataFrame:
    """(ts, turnover, commission, slippage, spread, total) of moving from old to new weights (ts, ticker, w)."""
    both = old.select("ts", "ticker", F.col("w").alias("a")).join(new.select("ts", "ticker", F.col("w").alias("b")), ["ts", "ticker"], "full_outer")
    t = both.groupBy("ts").agg(F.sum(F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))).alias("turnover"))
    part = lambda bps: F.col("turnover") * value * bps / 10_000.0
    t = t.withColumn("commission", part(COMMISSION)).withColumn("slippage", part(SLIPPAGE)).withColumn("spread", part(SPREAD / 2))
    return t.withColumn("total", F.col("commission") + F.col("slippage") + F.col("spread"))


def rebalance_dates(calendar: DataFrame, every: str = "month", exact: bool = False) -> DataFrame:
    """Last trading day of each period; with ``exact`` only periods whose last calendar day is one (weeks end on Friday)."""
    unit = {"month": "month", "week": "week", "quarter": "quarter"}[every]
    start = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    last = {"month": F.last_day("ts"), "week": F.date_add(F.to_date(start), 4), "quarter": F.date_sub(F.to_date(start + F.expr("INTERVAL 3 MONTH")), 1)}[every]
    g = calendar.withColumn("end", last).where("ts <= end").groupBy("end").agg(F.max("ts").alias("ts"))
    return (g.where("ts = end") if exact else g).select("ts")


def benchmarks(returns: DataFrame, x: str = "ret") -> DataFrame:
    """(ts, equal, inverse_variance, inverse_std): growth of one unit; weights look at the whole window."""
    r = F.coalesce(F.col(x), F.lit(0.0))
    stats = returns.groupBy("ticker").agg(F.var_samp(x).alias("var")).where("var > 0")
    stats = stats.withColumns({"iv": 1 / F.col("var"), "is": 1 / F.sqrt("var")})
    total = stats.agg(F.sum("iv").alias("tiv"), F.sum("is").alias("tis"))
    weights = stats.join(F.broadcast(total)).select("ticker", (F.col("iv") / F.col("tiv")).alias("wv"), (F.col("is") / F.col("tis")).alias("ws"))
    daily = returns.join(weights, "ticker", "left").groupBy("ts").agg(F.avg(r).alias("e"), F.sum(r * F.coalesce("wv", F.lit(0.0))).alias("v"), F.sum(r * F.coalesce("ws", F.lit(0.0))).alias("s"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grow = lambda c: F.exp(F.sum(F.log1p(c)).over(w))
    return daily.select("ts", grow("e").alias("equal"), grow("v").alias("inverse_variance"), grow("s").alias("inverse_std"))


@dataclass
class Backtest:
    """Walk-forward run over one panel, from the first to the last day with an expected return; returns before that feed the
    covariance alone. Regime codes choose the limits; an unknown one takes those of 1. Drifted weights are brought to a sum of one, unless cash is kept.
    """

    limits: dict[int, Limits] = field(default_factory=lambda: {2: Limits(1, 0.05, 0.5, "min_variance"), 1: Limits(), 0: Limits()})
    capital: float = 1e8
    method: str = "ledoit_wolf"
    keep_cash: bool = False

    def run_frame(self, pdf: pd.DataFrame, rebalance: set) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
        """(equity, turnover, weights) from rows (ts, ticker, ret, mu, regime); costs go from net alone."""
        ret = pdf.pivot(index="ts", columns="ticker", values="ret").sort_index()
        mu = pdf.pivot(index="ts", columns="ticker", values="mu").reindex_like(ret)
        regime = pdf.groupby("ts")["regime"].last().reindex(ret.index).ffill().fillna(1).astype(int)
        past, days, names = ret.to_numpy(np.float64), list(ret.index), list(ret.columns)
        x = np.nan_to_num(past)
        live = np.flatnonzero(mu.notna().to_numpy().any(1))
        w, gross, net = np.zeros(len(names)), self.capital, self.capital
        equity, turns, held = [], [], []
        for t in range(live[0], live[-1] + 1) if len(live) else ():
            day = days[t]
            r = float(w @ x[t])
            gross, net = gross * (1 + r), net * (1 + r)
            w = w * (1 + x[t])
            total = 1 + r if self.keep_cash else w.sum()
            w = w / total if total > 0 else w
            use = mu.iloc[t].notna().to_numpy()
            if day in rebalance and use.any():
                limits = self.limits.get(int(regime.iloc[t]), self.limits[1])
                cov = covariance(past[:t], self.method)
                new = np.zeros_like(w)
                new[use] = optimise(mu.iloc[t].to_numpy()[use], cov[np.ix_(use, use)], w[use], limits)
                traded = float(np.abs(new - w).sum())
                parts = [traded * net * b / 10_000 for b in (COMMISSION, SLIPPAGE, SPREAD / 2)]
                net -= sum(parts)
                turns.append((day, traded, *parts, sum(parts), net))
                w = new
            equity.append((day, gross, net))
            held += [(day, names[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-5)]
        return (
            pd.DataFrame(equity, columns=["ts", "gross", "net"]),
            pd.DataFrame(turns, columns=["ts", "turnover", "commission", "slippage", "spread", "cost", "value"]),
            pd.DataFrame(held, columns=["ts", "ticker", "w"]),
        )

    def run(self, rows: DataFrame, rebalance: DataFrame, part: str = "equity", period: str = "period") -> DataFrame:
        """One of the three results for each ``period`` of the rows. A period is one task: its state depends on every day before."""
        days = {r["ts"] for r in rebalance.collect()}  # one row for each period of the calendar
        at = {"equity": 0, "turnover": 1, "weights": 2}[part]
        schema = [
            "ts date, gross double, net double", "ts date, turnover double, commission double, slippage double, spread double, cost double, value double", "ts date, ticker string, w double"
        ][at]

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            out = self.run_frame(pdf, days)[at]
            out.insert(0, period, pdf[period].iloc[0])
            return out

        return rows.groupBy(period).applyInPandas(go, f"{period} string, {schema}")


def spread(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """a - b on common dates."""
    return a.join(b.select("ts", F.col("value").alias("__b")), "ts").select("ts", F.lit(name).alias("feature"), (F.col("value") - F.col("__b")).alias("value"))


def daily_return(x: Column, w) -> Column:
    return ratio(x, F.lag(x).over(w)) - 1
