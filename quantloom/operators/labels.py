"""Triple-barrier labels, their validation, weights by overlap, and the sequential bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import log, ratio
from quantloom.operators.reshape import hit_label, hit_name


def paths(panel: DataFrame, horizon: int = 5, of: str | Column = "true") -> DataFrame:
    """The bars for which ``of`` holds, each with the following ``horizon`` rows of its ticker as an array; no join.

    The window gives one reference for each of these rows; only the bars that are kept make an array of them.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    bar = F.struct("ts", F.coalesce("h", "c").alias("h"), F.coalesce("l", "c").alias("l"), F.col("c").alias("c"))
    names = [f"__p{k}" for k in range(1, horizon + 1)]
    ahead = panel.withColumn("__bar", bar).withColumns({n: F.lead("__bar", k + 1).over(w) for k, n in enumerate(names)})
    return ahead.where(of).withColumn("path", F.array_compact(F.array(*names))).drop("__bar", *names)


def triple_barrier(panel: DataFrame, pt: float = 1.0, sl: float = 1.0, horizon: int = 5, policy: str = "conservative") -> DataFrame:
    """Labels of the events in ``panel`` (ticker, ts, h, l, c, vol, is_event): the first barrier that a later bar touches.

    A bar that touches both counts as stop-loss, as profit under ``optimistic``, and is passed over under ``ignore``. Without a touch the
    close of the last row in reach counts; on the last row of all that is the entry itself. Rows without price,
    barriers or exit price go.
    """
    e = paths(panel, horizon, "is_event").withColumn("pt", F.col("c") * (1 + pt * F.col("vol"))).withColumn("sl", F.col("c") * (1 - sl * F.col("vol")))
    up = lambda x: F.coalesce(x["h"] >= F.col("pt"), F.lit(False))
    down = lambda x: F.coalesce(x["l"] <= F.col("sl"), F.lit(False))
    touch = (lambda x: up(x) != down(x)) if policy == "ignore" else (lambda x: up(x) | down(x))
    first = F.get(F.filter("path", touch), F.lit(0))
    e = e.withColumn("first", first).withColumn("last", F.get("path", F.size("path") - 1))
    profit = up(F.col("first")) if policy == "optimistic" else ~down(F.col("first"))
    code = F.when(F.col("first").isNull(), 3).when(profit, 1).otherwise(2)
    e = e.withColumn("code", code)
    exit_ts = F.when(F.col("first").isNotNull(), F.col("first.ts")).otherwise(F.coalesce("last.ts", "ts"))
    exit_px = F.when(F.col("code") == 1, F.col("pt")).when(F.col("code") == 2, F.col("sl")).when(F.col("last").isNull(), F.col("c")).otherwise(F.col("last.c"))
    out = e.select(
        "ticker", "ts", F.col("c").alias("price"), "pt", "sl", "vol", F.coalesce("last.ts", "ts").alias("vertical_ts"), exit_ts.alias("exit_ts"), exit_px.alias("exit_price"),
        hit_name(F.col("code")).alias("hit"), hit_label(F.col("code")).alias("label"),
    )
    out = out.where((F.col("vol") > 0) & (F.col("price") > 0)).na.drop(subset=["pt", "sl", "exit_price"])
    return out.withColumn("holding", F.date_diff("exit_ts", "ts")).withColumn("ret", log(ratio(F.col("exit_price"), F.col("price"))))


def label_violations(labels: DataFrame) -> DataFrame:
    """Counts of broken label rules in one pass, one row each."""
    dup = labels.groupBy("ticker", "ts").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_key"))
    rules = {
        "exit_before_entry": F.col("exit_ts") < F.col("ts"), "exit_after_vertical": F.col("exit_ts") > F.col("vertical_ts"), "bad_label": ~F.col("label").isin(-1, 0, 1),
        "bad_hit": ~F.col("hit").isin("PT", "SL", "VERTICAL"), "barrier_order": F.col("pt") <= F.col("sl"), "price": F.col("price") <= 0, "holding": F.col("holding") < 0,
    }
    g = labels.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return g.unpivot([], None, "rule", "n").unionByName(dup.unpivot([], None, "rule", "n"))


def event_violations(events: DataFrame) -> DataFrame:
    dup = events.groupBy("ticker", "ts").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_key"))
    g = events.agg(F.count_if(F.col("threshold") <= 0).alias("threshold"), F.count_if(F.col("vol").isNull()).alias("volatility"))
    return g.unpivot([], None, "rule", "n").unionByName(dup.unpivot([], None, "rule", "n"))


def require_none(found: DataFrame) -> None:
    """Raise if a rule of a violations table is broken."""
    broken = {r["rule"]: r["n"] for r in found.where("n > 0").collect()}
    if broken:
        raise ValueError(f"broken rules: {broken}")


def concurrency(labels: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ts, pos, n): labels alive on each date, over all tickers, by a sweep over starts and ends."""
    start = labels.join(calendar, "ts").select("pos", F.lit(1).alias("d"))
    end = labels.join(calendar.select(F.col("ts").alias("exit_ts"), "pos"), "exit_ts").select((F.col("pos") + 1).alias("pos"), F.lit(-1).alias("d"))
    steps = start.union(end).groupBy("pos").agg(F.sum("d").alias("d"))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one row for each date
    return calendar.join(steps, "pos", "left").select("ts", "pos", F.sum(F.coalesce("d", F.lit(0))).over(w).alias("n"))


def uniqueness(labels: DataFrame, calendar: DataFrame) -> DataFrame:
    """``labels`` with the mean of 1 / concurrency over their lives, from a prefix sum; 0 for a life off the calendar."""
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(0.0)
    sums = concurrency(labels, calendar).withColumn("own", share).withColumn("sum", F.sum("own").over(w))
    a = sums.select("ts", F.col("pos").alias("__a"), (F.col("sum") - F.col("own")).alias("__sa"))
    b = sums.select(F.col("ts").alias("exit_ts"), F.col("pos").alias("__b"), F.col("sum").alias("__sb"))
    u = (F.col("__sb") - F.col("__sa")) / (F.col("__b") - F.col("__a") + 1)
    out = labels.join(a, "ts", "left").join(b, "exit_ts", "left")
    return out.withColumn("uniqueness", F.when(F.col("__b") >= F.col("__a"), u).otherwise(0.0)).drop("__a", "__sa", "__b", "__sb")


def sample_weights(weighted: DataFrame, least: float = 1e-6) -> DataFrame:
    r: Column = F.abs(log(ratio(F.col("exit_price"), F.col("price"))))
    return weighted.withColumn("weight", F.col("uniqueness") * F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(least)))


def sequential_bootstrap(spans: DataFrame, n: int, dates: int, seed: int = 42, batches: int = 100, remainder: bool = True) -> DataFrame:
    """(label_index, n_draws): labels drawn with chances that follow their uniqueness given what was drawn before.

    ``spans`` (label_index, a, b) are positions on a calendar of ``dates`` rows. The state is one count for each date. Chances are the
    same for all labels with one life, so draws go to distinct lives, at most dates * horizon of them, and
    then evenly to their labels; only distinct lives reach the driver.
    """
    lives = spans.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).orderBy("a", "b").collect()
    spark = spans.sparkSession
    if not lives or n < 1:
        return spark.createDataFrame([], "label_index long, n_draws long")
    a, b, m = (np.array([r[k] for r in lives], np.int64) for k in ("a", "b", "m"))
    rng = np.random.RandomState(seed)
    phi, size, drawn = np.zeros(dates), max(1, n // batches), []
    left = n if remainder else min(n, batches * size)
    while left > 0:
        prefix = np.r_[0.0, np.cumsum(1 / (phi + 1))]
        u = (prefix[b + 1] - prefix[a]) / (b - a + 1)
        p = m * u
        p = p / p.sum() if p.sum() > 0 else m / m.sum()
        take = size if left >= 2 * size else left
        pick = rng.choice(len(a), size=take, p=p, replace=True)
        drawn.append(np.stack([pick, rng.randint(0, m[pick])]))
        step = np.zeros(dates + 2)
        np.add.at(step, a[pick], 1)
        np.add.at(step, b[pick] + 1, -1)
        phi += np.cumsum(step)[:dates]
        left -= take
    pairs, counts = np.unique(np.concatenate(drawn, 1), axis=1, return_counts=True)
    table = spark.createDataFrame([(int(a[i]), int(b[i]), int(j), int(c)) for i, j, c in zip(*pairs, counts, strict=True)], "a long, b long, nth long, n_draws long")
    ranked = spans.withColumn("nth", F.row_number().over(Window.partitionBy("a", "b").orderBy("label_index")).cast("long") - 1)
    return ranked.join(table, ["a", "b", "nth"]).select("label_index", "n_draws")
