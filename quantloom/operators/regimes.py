"""Market regimes by a Gaussian hidden Markov model that is refitted as time goes on."""

from __future__ import annotations

from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of each row under each state."""
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        low = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(low, (x - mean[k]).T)
        out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def forward(logb: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered probabilities, log scale) of each row. Plain numbers: with few states arrays cost more than they save."""
    shift = logb.max(1)
    b, columns = np.exp(logb - shift[:, None]).tolist(), move.T.tolist()
    k = len(start)
    now, a, scale = start.tolist(), [], []
    for t, x in enumerate(b):
        now = [p * q for p, q in zip((sum(map(mul, now, c)) for c in columns) if t else now, x, strict=True)]
        s = sum(now)
        now = [p / s for p in now] if s > 0 else [1 / k] * k
        a.append(now)
        scale.append(s)
    return np.array(a).reshape(len(b), k), np.log(np.maximum(np.array(scale), 1e-300)) + shift


def backward(b: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What the rows after each one say about its state, scaled to a sum of one; ones for the last row."""
    k, table = len(move), move.tolist()
    now, out = [1.0] * k, [[1.0] * k]
    for x in b[:0:-1].tolist():
        v = list(map(mul, x, now))
        now = [sum(map(mul, r, v)) for r in table]
        s = sum(now)
        now = [p / s for p in now]
        out.append(now)
    return np.array(out[::-1])


def fit_hmm(x: np.ndarray, states: int = 3, rounds: int = 100, tol: float = 1e-4, ridge: float = 1e-3):
    """(start, move, mean, cov, log likelihoods) by Baum-Welch from quantiles of the row norm; no chance is involved."""
    n, d = x.shape
    order = np.argsort((x * x).sum(1), kind="stable")
    parts = np.array_split(order, states)
    mean = np.stack([x[p].mean(0) for p in parts])
    cov = np.stack([np.cov(x[p].T, bias=True).reshape(d, d) + ridge * np.eye(d) for p in parts])
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    seen: list[float] = []
    for _ in range(rounds):
        logb = _density(x, mean, cov)
        a, scale = forward(logb, start, move)
        seen.append(float(scale.sum()))
        b = np.exp(logb - logb.max(1, keepdims=True))
        beta = backward(b, move)
        step = a[:-1, :, None] * move * (b[1:] * beta[1:])[:, None, :]
        joint = (step / step.sum((1, 2), keepdims=True)).sum(0)
        g = a * beta
        g /= g.sum(1, keepdims=True)
        start, move = g[0], joint / joint.sum(1, keepdims=True)
        w = g.sum(0) + 1e-12
        mean = (g.T @ x) / w[:, None]
        for k in range(states):
            z = x - mean[k]
            cov[k] = (g[:, k, None] * z).T @ z / w[k] + ridge * np.eye(d)
        if len(seen) > 1 and seen[-1] - seen[-2] < tol:
            break
    rank = np.argsort([np.trace(c) for c in cov], kind="stable")  # calm states first
    return start[rank], move[np.ix_(rank, rank)], mean[rank], cov[rank], seen


def expanding_regimes(df: DataFrame, features: list[str], states: int = 3, least: int = 504, every: int = 60, rounds: int = 100) -> DataFrame:
    """(ts, regime_0_prob, ..., regime_label) for each date from position ``least`` on, seen from that date alone.

    The model is refitted at position ``least`` and at each later multiple of ``every``, on the rows before; each
    refit is one task with the rows up to the next. The last smoothed posterior of a prefix is the forward-filtered one.
    """
    w = Window.orderBy("ts")  # one row for each date
    filled = [F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in features]
    rows = df.select("ts", *filled).na.drop(subset=features).withColumn("pos", F.row_number().over(w) - 1)
    n = rows.count()
    refits = [least, *[t for t in range(every * (least // every + 1), n, every)]] if n > least else []
    probs = ", ".join(f"regime_{k}_prob double" for k in range(states))
    schema = f"ts date, {probs}, regime_label int"
    spark = df.sparkSession
    if not refits:
        return spark.createDataFrame([], schema)
    blocks = spark.createDataFrame([(a, b) for a, b in zip(refits, [*refits[1:], n], strict=True)], "fit int, until int")
    every_block = rows.join(F.broadcast(blocks), F.col("pos") < F.col("until"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        t, x = int(pdf["fit"].iloc[0]), pdf[features].to_numpy(np.float64)
        mean, std = x[:t].mean(0), x[:t].std(0)
        z = (x - mean) / np.where(std > 0, std, 1)
        start, move, mu, cov, _ = fit_hmm(z[:t], states, rounds)
        p, _ = forward(_density(z, mu, cov), start, move)
        p = p[t:]
        return pd.DataFrame({"ts": pdf["ts"].iloc[t:].to_numpy(), **{f"regime_{k}_prob": p[:, k] for k in range(states)}, "regime_label": p.argmax(1).astype(np.int32)})

    # A stated number of partitions is not coalesced, so that small blocks still run side by side.
    return every_block.repartition(len(refits), "fit").groupBy("fit").applyInPandas(run, schema)


def regime_diagnostics(regimes: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """Days, total variance, feature means and the share of days that stay, by regime."""
    w = Window.orderBy("ts")
    nxt = F.lead("regime_label").over(w)
    r = regimes.select("ts", "regime_label").withColumn("stays", F.when(nxt.isNotNull(), (nxt == F.col("regime_label")).cast("double")))
    total = sum((F.coalesce(F.var_pop(c), F.lit(0.0)) for c in features), F.lit(0.0))
    return r.join(df, "ts").groupBy("regime_label").agg(F.count(F.lit(1)).alias("days"), total.alias("total_variance"), *[F.avg(c).alias(f"{c}_mean") for c in features], F.avg("stays").alias("stay_share"))


def standardised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns less their mean over their population deviation; two aggregates, broadcast as one row."""
    g = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    j = df.join(F.broadcast(g))
    return j.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))).alias(n) for c, n in columns.items()])


def silhouette(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Silhouette of the states by squared distance, from sums of each state; no pair of rows meets."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="x").transform(df.withColumn("prediction", F.col(label).cast("double")))
    many = x.select(label).distinct().count() > 1
    value = ClusteringEvaluator(featuresCol="x").evaluate(x) if many else 0.0
    return df.sparkSession.createDataFrame([("silhouette", float(value))], "metric string, value double")
