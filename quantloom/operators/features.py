"""Window features of the panel. All share one partitioning and order, so Spark sorts once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import expanding, log, ratio, rolling, series

HORIZONS = (5, 10, 20, 60)
YEAR = math.sqrt(252.0)


def log_returns(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    w, c = series(), F.col("c")
    return df.withColumns({f"log_ret_{k}d": log(ratio(c, F.lag(c, k).over(w))) for k in (1, *horizons)})


def price_ranges(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Distance to rolling high and low, rolling range, and breakout over the earlier high."""
    w, h, low, c = series(), F.col("h"), F.col("l"), F.col("c")
    out = {}
    for k in horizons:
        top, floor = rolling(F.max, h, k, w), rolling(F.min, low, k, w)
        out |= {
            f"rolling_high_{k}d": ratio(top, c) - 1, f"rolling_low_{k}d": ratio(floor, c) - 1, f"rolling_range_{k}d": ratio(top - floor, c),
            f"breakout_{k}d": ratio(c - rolling(F.max, h, k, w, shift=1), c),
        }
    return df.withColumns(out)


def momentum(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    w, c = series(), F.col("c")
    out = {}
    for k in horizons:
        out |= {f"roc_{k}d": ratio(c, F.lag(c, k).over(w)) - 1, f"price_to_sma_{k}d": ratio(c, rolling(F.avg, c, k, w)) - 1}
    if {5, 20} <= set(horizons):
        out["sma_cross_5_20"] = ratio(rolling(F.avg, c, 5, w), rolling(F.avg, c, 20, w)) - 1
    return df.withColumns(out)


def realised_volatility(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    w, c = series(), F.col("c")
    r = df.withColumn("__r", log(ratio(c, F.lag(c).over(w))))
    return r.withColumns({f"realized_vol_{k}d": rolling(F.stddev_samp, F.col("__r"), k, w) * YEAR for k in horizons}).drop("__r")


def average_true_range(df: DataFrame, n: int = 14) -> DataFrame:
    w = series()
    before = F.lag("c").over(w)
    t = df.withColumn("true_range", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)))
    return t.withColumn(f"atr_{n}d_norm", ratio(rolling(F.avg, F.col("true_range"), n, w), F.col("c")))


def volume(df: DataFrame, n: int = 20) -> DataFrame:
    w, v = series(), F.col("v")
    mean = rolling(F.avg, v, n, w)
    out = {f"vol_ma_{n}d": mean, f"rel_vol_{n}d": ratio(v, mean), f"vol_zscore_{n}d": ratio(v - mean, rolling(F.stddev_samp, v, n, w))}
    if n >= 20:
        out["vol_momentum"] = ratio(rolling(F.avg, v, 5, w), mean)
    return df.withColumns(out)


def cross_asset(df: DataFrame, benchmarks: list[str], n: int = 20) -> DataFrame:
    """Return and strength against other tickers of the panel, by date; unknown names are an error."""
    w, c = series(), F.col("c")
    known = {r["ticker"] for r in df.where(F.col("ticker").isin(benchmarks)).select("ticker").distinct().collect()}
    if missing := set(benchmarks) - known:
        raise ValueError(f"unknown benchmarks: {sorted(missing)}")
    own = df.withColumn("__r", log(ratio(c, F.lag(c).over(w)))).withColumn("__s", ratio(c, F.lag(c, n).over(w)))
    for b in benchmarks:
        other = own.where(F.col("ticker") == b).select("ts", F.col("__r").alias("__rb"), F.col("__s").alias("__sb"))
        own = own.join(other, "ts", "left").withColumns({f"rel_ret_{b}": F.col("__r") - F.col("__rb"), f"rs_{b}_{n}d": ratio(F.col("__s"), F.col("__sb")) - 1}).drop("__rb", "__sb")
    return own.drop("__r", "__s")


def asof_returns(df: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Log return against the last bar that is more than a day older; rows without one go."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("ticker").orderBy(at).rangeBetween(Window.unboundedPreceding, -(seconds + 1))
    prev = F.last(F.struct("ts", "c")).over(w)
    return df.withColumn("__p", prev).where("__p IS NOT NULL").withColumn("prev_ts", F.col("__p.ts")).withColumn("ret", log(ratio(F.col("c"), F.col("__p.c")))).drop("__p")


def drawdown(df: DataFrame, x: str = "c") -> DataFrame:
    top = F.max(x).over(expanding(series()))
    return df.withColumn("cummax", top).withColumn("drawdown", ratio(F.col(x) - F.col("cummax"), F.col("cummax")))


def rolling_performance(df: DataFrame, r: str, n: int = 126) -> DataFrame:
    w = series()
    mean, std = rolling(F.avg, F.col(r), n, w), rolling(F.stddev_samp, F.col(r), n, w)
    return df.withColumn("roll_ret", mean * 252).withColumn("roll_vol", std * YEAR).withColumn("roll_sharpe", F.col("roll_ret") / (F.col("roll_vol") + 1e-6))


def equity_curve(df: DataFrame, r: str) -> DataFrame:
    """Running product of 1 + r; null returns count as none."""
    x = F.coalesce(F.col(r), F.lit(0.0))
    return df.withColumn("equity", F.exp(F.sum(F.log1p(x)).over(expanding(series()))))


def expanding_zscore(df: DataFrame, x: str, least: int = 20) -> DataFrame:
    e = expanding(series())
    z = ratio(F.col(x) - F.avg(x).over(e), F.stddev_samp(x).over(e))
    return df.withColumn("z", F.when(F.count(x).over(e) >= least, z))


def islands(df: DataFrame, state: str) -> DataFrame:
    """Blocks of equal states: (ticker, block, state, start, end, n)."""
    w = series()
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    b = df.withColumn("__c", change).withColumn("block", F.sum("__c").over(expanding(w)))
    return b.groupBy("ticker", "block").agg(F.max(state).alias("state"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


def rule_regime(df: DataFrame, fast: int = 21, slow: int = 63) -> DataFrame:
    """Momentum and volatility features and the rule-based regime over them."""
    w, c = series(), F.col("c")
    r = df.withColumn("__r", ratio(c, F.lag(c).over(w)) - 1)
    r = r.withColumns({f"mom_{k}": ratio(c, F.lag(c, k).over(w)) - 1 for k in (5, fast, slow, 126)})
    r = r.withColumns({f"rv_{k}": rolling(F.stddev_samp, F.col("__r"), k, w) * YEAR for k in (5, fast, slow)})
    calm = F.col(f"rv_{fast}") <= F.col(f"rv_{slow}")
    state = F.when(F.col(f"mom_{slow}").isNull() | F.col(f"rv_{slow}").isNull(), None).when((F.col(f"mom_{slow}") > 0) & calm, "bull").when((F.col(f"mom_{slow}") <= 0) & ~calm, "crisis").otherwise("neutral")
    return r.withColumn("regime", state).drop("__r")


def bollinger(df: DataFrame, n: int = 20, wide: float = 2.0) -> DataFrame:
    w, c = series(), F.col("c")
    mid, sd = rolling(F.avg, c, n, w), rolling(F.stddev_samp, c, n, w)
    return df.withColumns({"mid": mid, "upper": mid + wide * sd, "lower": mid - wide * sd})
