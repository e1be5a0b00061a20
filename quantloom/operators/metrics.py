"""Model and portfolio metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, label: str = "label", pred: str = "pred") -> dict[str, float]:
    """Accuracy, balanced accuracy, Matthews correlation and macro / weighted scores, from the confusion counts."""
    cells = {(r[0], r[1]): r[2] for r in confusion(df, label, pred).collect()}
    classes = sorted({x for ab in cells for x in ab})
    total = sum(cells.values())
    t = {k: sum(n for (a, _), n in cells.items() if a == k) for k in classes}
    p = {k: sum(n for (_, b), n in cells.items() if b == k) for k in classes}
    good = {k: cells.get((k, k), 0) for k in classes}
    right = sum(good.values())
    prec = {k: good[k] / p[k] if p[k] else 0.0 for k in classes}
    rec = {k: good[k] / t[k] if t[k] else 0.0 for k in classes}
    f1 = {k: 2 * prec[k] * rec[k] / (prec[k] + rec[k]) if prec[k] + rec[k] else 0.0 for k in classes}
    cov = right * total - sum(t[k] * p[k] for k in classes)
    norm = ((total**2 - sum(x * x for x in p.values())) * (total**2 - sum(x * x for x in t.values()))) ** 0.5
    seen = [k for k in classes if t[k]]
    out = {"accuracy": right / total, "balanced_accuracy": sum(rec[k] for k in seen) / len(seen), "mcc": cov / norm if norm else 0.0}
    for name, d in (("precision", prec), ("recall", rec), ("f1", f1)):
        out[f"macro_{name}"] = sum(d.values()) / len(classes)
        out[f"weighted_{name}"] = sum(d[k] * t[k] for k in classes) / total
        out |= {f"{name}_{k}": d[k] for k in classes}
    return out | {f"support_{k}": float(t[k]) for k in classes}


def per_class(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support) with DataFrame operations."""
    hit = F.col("a") == F.col("b")
    c = confusion(df, label, pred).toDF("a", "b", "n")
    sides = c.select(F.col("a").alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(hit, F.col("n")).otherwise(0).alias("g")).union(
        c.select("b", F.lit(0), "n", F.lit(0))
    )
    s = sides.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    zero = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    s = s.withColumn("precision", zero("g", "p")).withColumn("recall", zero("g", "support"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return s.select("class", "precision", "recall", f1.alias("f1"), "support")


def binary(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    g = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count(F.lit(1)).alias("n"),
               F.count_if(y == p).alias("ok"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    g = g.withColumn("accuracy", F.col("ok") / F.col("n")).withColumn("precision", part("tp", F.col("tp") + F.col("fp"))).withColumn("recall", part("tp", F.col("tp") + F.col("fn")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return g.select("accuracy", "precision", "recall", f1.alias("f1"))


def calibration(df: DataFrame, label: str = "y", p: str = "p", clip: float = 1e-15, ranges: int = 256) -> DataFrame:
    """Brier score, log loss and AUC. Ranks are counted inside ``ranges`` ranges of scores, whose bounds are approximate quantiles, and
    the rows before a range are added, so no task sorts all scores. The bounds are found when the query is built.
    """
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    loss = df.agg(
        F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.avg(-(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q))).alias("log_loss")
    )
    bounds = sorted(set(df.agg(F.percentile_approx(p, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []))
    place = F.array_position(F.transform(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: F.col(p) < b), True).cast("int") if bounds else F.lit(0)
    s = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    s = s.withColumn("range", F.when(place == 0, len(bounds) + 1).otherwise(place))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = s.groupBy("range").agg(F.sum("n").alias("in")).select("range", F.coalesce(F.sum("in").over(upto), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("inside", inside).join(F.broadcast(base), "range").withColumn("rank", F.col("base") + F.col("inside") + (F.col("n") + 1) / 2)
    g = s.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    auc = (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / F.nullif(F.col("a") * F.col("b"), F.lit(0))
    return loss.join(F.broadcast(g.select(auc.alias("auc"))))


def profit_lift(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    y, kept = F.col(label), F.col(pred) == 1
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("n_kept"), F.avg(y.cast("double")).alias("base"), F.avg(F.when(kept, y.cast("double"))).alias("filtered"))
    return g.select("n", "n_kept", "base", F.coalesce("filtered", F.lit(0.0)).alias("filtered"), (F.coalesce("filtered", F.lit(0.0)) - F.col("base")).alias("lift"), (F.col("n_kept") / F.col("n")).alias("retention"))


def performance(equity: DataFrame, turnover: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of portfolio metrics from (ts, gross, net), (ts, turnover, cost) and (ts, bench).

    Windows run over one row for each date.
    """
    w = Window.orderBy("ts")
    e = equity.join(benchmark, "ts", "left").withColumn("r", F.col("net") / F.lag("net").over(w) - 1).withColumn("b", F.col("bench") / F.lag("bench").over(w) - 1)
    top = F.max("net").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("dd", F.col("net") / top - 1)
    r, b = F.col("r"), F.col("b")
    both = b.isNotNull() & r.isNotNull()
    span = lambda x: F.max_by(x, "ts") / F.min_by(x, "ts")
    g = e.agg(
        span("net").alias("growth"), span("gross").alias("gross_growth"), span("bench").alias("bench_growth"), F.date_diff(F.max("ts"), F.min("ts")).alias("days"), F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"), F.stddev_samp(F.when(r < 0, r)).alias("down"), F.min("dd").alias("max_drawdown"), F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"),
        F.covar_samp(F.when(both, r), F.when(both, b)).alias("cov"), F.var_pop(F.when(both, b)).alias("var"), F.avg(F.when(both, b)).alias("mean_b"), F.avg(F.when(both, r)).alias("mean_r"),
        F.stddev_samp(F.when(both, r - b)).alias("te"), F.count_if(both).alias("n_both"),
    )
    t = turnover.withColumn("gap", F.date_diff("ts", F.lag("ts").over(w))).agg(F.avg("turnover").alias("mean_turnover"), F.avg("gap").alias("gap"), F.sum("cost").alias("total_cost"))
    year = lambda x: F.pow(F.col(x), 365.25 / F.col("days")) - 1
    vol = F.col("std") * 252**0.5
    g = g.join(F.broadcast(t)).withColumn("cagr", year("growth")).withColumn("gross_cagr", year("gross_growth")).withColumn("bench_cagr", year("bench_growth")).withColumn("volatility", vol)
    safe = lambda x: F.when(x > 0, x).otherwise(1e-6)
    beta = F.when((F.col("n_both") > 2) & (F.col("var") > 0), F.col("cov") / F.col("var"))
    error = F.col("te") * 252**0.5
    yearly = F.col("mean_turnover") * 252 / F.when(F.col("gap") != 0, F.col("gap")).otherwise(1)
    return g.select(
        "cagr", "gross_cagr", "bench_cagr", (F.col("gross_cagr") - F.col("cagr")).alias("cost_drag"), F.col("cagr").alias("annual_return"), "volatility", (F.col("mean") * 252 / safe(F.col("volatility"))).alias("sharpe"), (F.col("mean") * 252 / safe(F.col("down") * 252**0.5)).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"), yearly.alias("annual_turnover"), F.when(yearly > 0, 252 / yearly).alias("holding_days"), "win_rate",
        beta.alias("beta"), ((F.col("mean_r") - beta * F.col("mean_b")) * 252).alias("alpha"), error.alias("tracking_error"),
        F.when((F.col("n_both") > 2) & (error > 0), (F.col("cagr") - F.col("bench_cagr")) / error).alias("information_ratio"), F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), "mean_turnover",
    )
