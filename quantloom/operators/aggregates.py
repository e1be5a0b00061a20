"""Aggregations: bars, profiles, registries, validation, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.stage import staged


def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """Bars of (ticker, ts) from prices ``px`` and quantities ``q`` in the order ``ord``; partial aggregates only."""
    return ticks.groupBy("ticker", "ts").agg(
        F.min_by("px", "ord").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "ord").alias("c"), F.sum("q").alias("v")
    )


def merge_bars(bars: DataFrame, order: Column) -> DataFrame:
    """One bar for each (ticker, ts): full duplicates go first; then open first, high most, low least, close last, volume sum."""
    b = bars.dropDuplicates().withColumn("__ord", order)
    return b.groupBy("ticker", "ts").agg(F.min_by("o", "__ord").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "__ord").alias("c"), F.sum("v").alias("v"))


def keep_one(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key; the row travels as one aggregate, without a sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return df.groupBy(*keys).agg(pick.alias("__r")).select("__r.*")


def volatility_summary(df: DataFrame, x: str = "vol", group: str = "ticker") -> DataFrame:
    """Mean, median, deviation, range and coverage of the calendar; groups without a value are skipped."""
    v = F.col(x)
    return (
        df.groupBy(group)
        .agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
             (100.0 * F.count(v) / F.count(F.lit(1))).alias("coverage"))
        .where("mean IS NOT NULL")
    )


def event_statistics(events: DataFrame, span: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Per ticker: events, yearly rate over its life in days (0 for none), directions, whole days between events, mean threshold."""
    gap = F.date_diff("ts", F.lag("ts").over(C.series()))
    e = events.withColumn("gap", gap)
    up = F.col("direction") == "Positive"
    g = e.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(up).alias("n_pos"), F.count_if(~up).alias("n_neg"), F.avg("gap").alias("mean_gap"),
        F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("threshold").alias("mean_threshold"),
    )
    life = span.groupBy("ticker").agg(F.date_diff(F.max("ts"), F.min("ts")).alias("days"))
    rate = F.when(F.col("days") > 0, F.col("n") / F.col("days") * per_year).otherwise(0.0)
    return g.join(life, "ticker").withColumn("per_year", rate).withColumn("pct_pos", 100.0 * F.col("n_pos") / F.col("n")).drop("days")


def label_statistics(labels: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    kind = lambda k: F.count_if(F.col("hit") == k)
    width = F.when(F.avg("vol") > 0, F.avg(F.col("pt") - F.col("sl"))).otherwise(0.0)
    return labels.groupBy("ticker").agg(
        n.alias("n"), kind("PT").alias("n_pt"), kind("SL").alias("n_sl"), kind("VERTICAL").alias("n_vertical"), (100.0 * kind("PT") / n).alias("pct_pt"),
        F.avg("holding").alias("mean_holding"), F.percentile("holding", 0.5).alias("median_holding"), F.avg("ret").alias("mean_ret"), F.percentile("ret", 0.5).alias("median_ret"),
        F.avg("vol").alias("mean_vol"), width.alias("mean_width"),
    )


def exact_percentiles(df: DataFrame, columns: list[str], points: list[float], most: int = 100_000) -> dict[tuple[str, float], float | None]:
    """Percentiles of whole columns, interpolated between the two nearest ranks; None without values.

    Each is held in a bracket of values, which approximate percentiles narrow, pass by pass, until it has at most ``most`` rows or one
    value; only then its distinct values are counted. So no task sees all values of a column. ``df`` is read a few times: write it first.
    """
    keys = [(c, p) for c in columns for p in points]
    low: dict = dict.fromkeys(keys)
    high: dict = dict.fromkeys(keys)
    out: dict[tuple[str, float], float | None] = {}
    grid = [k / 512 for k in range(513)]

    def inside(key: tuple[str, float]) -> Column:
        x, parts = F.col(key[0]), F.col(key[0]).isNotNull()
        if low[key] is not None:
            parts &= x >= low[key]
        return parts if high[key] is None else parts & (x <= high[key])

    todo = keys
    while todo:
        aggs = []
        for i, k in enumerate(todo):
            x = F.when(inside(k), F.col(k[0]))
            aggs += [F.count(k[0]).alias(f"n{i}"), F.count(x).alias(f"m{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                     (F.lit(0) if low[k] is None else F.count_if(F.col(k[0]) < low[k])).alias(f"u{i}")]
        r = df.agg(*aggs).first()
        small, wide = [], []
        ranks: dict = {}
        for i, k in enumerate(todo):
            if not r[f"n{i}"]:
                out[k] = None
                continue
            at = k[1] * (r[f"n{i}"] - 1)
            ranks[k] = (at, r[f"u{i}"], r[f"m{i}"])
            if r[f"a{i}"] == r[f"b{i}"]:
                out[k] = r[f"a{i}"]
            else:
                (small if r[f"m{i}"] <= most else wide).append(k)
        if small:
            each = F.explode(F.array_compact(F.array(*[F.when(inside(k), F.struct(F.lit(i).alias("i"), F.col(k[0]).cast("double").alias("x"))) for i, k in enumerate(small)]))).alias("e")
            seen: dict[int, list] = {}
            for q in df.select(each).groupBy("e.i", "e.x").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``most`` values for each
                seen.setdefault(q["i"], []).append((q["x"], q["n"]))
            for i, k in enumerate(small):
                at, done, _ = ranks[k]
                values = sorted(seen[i])
                ends, first, second = done, None, None
                for x, n in values:
                    ends += n
                    first = x if first is None and ends > int(at) else first
                    second = x if second is None and ends > math.ceil(at) else second
                out[k] = first + (second - first) * (at - int(at))
        if wide:
            found = df.agg(*[F.percentile_approx(F.when(inside(k), F.col(k[0])), grid, 10_000).alias(f"q{i}") for i, k in enumerate(wide)]).first()
            for i, k in enumerate(wide):
                at, done, m = ranks[k]
                a, b = (int(at) - done) / m, (math.ceil(at) - done) / m
                low[k], high[k] = found[i][max(0, int(a * 512) - 2)], found[i][min(512, math.ceil(b * 512) + 2)]
        todo = wide
    return out


def metric_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value): mean and median of each column."""
    df = staged(df.select(*columns))
    median = exact_percentiles(df, columns, [0.5])
    g = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.lit(median[c, 0.5]).cast("double").alias(f"median_{c}"))])
    return g.unpivot([], None, "metric", "value")


def missing_profile(panel: DataFrame, category: str = "Equity", group: str = "ticker", x: str = "c") -> DataFrame:
    """Missing values of each series on its calendar: outside its life, on weekends, the rest, and the probable cause."""
    v = F.col(x)
    life = Window.partitionBy(group)
    b = panel.withColumn("__first", F.min(F.when(v.isNotNull(), F.col("ts"))).over(life)).withColumn("__last", F.max(F.when(v.isNotNull(), F.col("ts"))).over(life))
    outside = F.col("__first").isNull() | (F.col("ts") < F.col("__first")) | (F.col("ts") > F.col("__last"))
    weekend = F.dayofweek("ts").isin(1, 7)
    g = b.groupBy(group).agg(
        F.count_if(v.isNull()).alias("total"), F.count_if(v.isNull() & outside).alias("structural"), F.count_if(v.isNull() & ~outside & weekend).alias("weekend"),
        F.count_if(v.isNull() & ~outside & ~weekend).alias("other"), F.count_if(~outside).alias("active"), (100.0 * F.count(v) / F.count(F.lit(1))).alias("coverage"),
    )
    other, equity = F.col("other"), F.lit(category == "Equity")
    cause = (
        F.when(F.col("active") == 0, "Structural Empty")
        .when(~equity & (other / F.greatest("active", F.lit(1)) > 0.5), "Release Frequency")
        .when(F.col("weekend") > other, "Weekends")
        .when(equity & (other > 0), "Holiday or Halt")
        .otherwise("Unexpected Missing")
    )
    return g.where("total > 0").withColumn("cause", cause).drop("active")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, range and 5 and 95 % points of each column, one row each."""
    df = staged(df.select(*columns))
    points = exact_percentiles(df, columns, [0.05, 0.95])
    parts = []
    for c in columns:
        x, p = F.col(c), lambda q, c=c: F.lit(points[c, q]).cast("double")
        parts.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                              p(0.05).alias("p05"), p(0.95).alias("p95"), F.max(x).alias("max")))
    return df.agg(F.array(*parts).alias("__a")).select(F.explode("__a").alias("r")).select("r.*")


def calendar_report(df: DataFrame, group: str = "ticker") -> DataFrame:
    """Trading days, weekend days of the span, and weekdays without trading."""
    g = df.groupBy(group).agg(F.count_distinct("ts").alias("days"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    days = F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))
    off = F.size(F.filter(days, lambda d: F.dayofweek(d).isin(1, 7)))
    return g.withColumn("weekends", off.cast("long")).withColumn("holidays", F.greatest(F.lit(0), F.size(days) - off - F.col("days")).cast("long"))


def fingerprint(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, columns, span, and an md5 over them."""
    g = df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).cast("string").alias("start"), F.max(ts).cast("string").alias("end"))
    g = g.withColumn("columns", F.lit(len(df.columns)).cast("long"))
    return g.withColumn("md5", F.md5(F.concat_ws("|", F.col("rows").cast("string"), F.col("columns").cast("string"), F.lit(",".join(df.columns)), "start", "end").cast("binary")))


def lifetimes(panel: DataFrame, x: str = "c", group: str = "ticker") -> DataFrame:
    valid = F.when(F.col(x).isNotNull(), F.col("ts"))
    return panel.groupBy(group).agg(
        F.min(valid).alias("first_valid"), F.max(valid).alias("last_valid"), F.count(x).alias("active_days"), (100.0 * F.count(x) / F.count(F.lit(1))).alias("coverage")
    )


def feature_diagnostics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share, deviation and constancy of each column in one pass."""
    parts = [
        F.struct(F.lit(c).alias("feature"), (100.0 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias("missing_pct"), F.stddev_samp(c).alias("std"),
                 (F.coalesce(F.min(c) == F.max(c), F.lit(True))).alias("constant"))
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("__a")).select(F.explode("__a").alias("r")).select("r.*")


def correlations(df: DataFrame, columns: list[str], complete: bool = False) -> DataFrame:
    """(a, b, corr) of each two columns, over the rows where both (or, if ``complete``, all) hold a value; one pass."""
    if complete:
        df = df.na.drop(subset=columns)
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("corr")))
    return df.agg(F.array(*parts).alias("__a")).select(F.explode("__a").alias("r")).select("r.*")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of each value."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(bars: DataFrame) -> DataFrame:
    """(rule, n, examples): broken price rules with the five earliest keys of each."""
    o, h, low, c, v = (F.col(x) for x in "ohlcv")
    rules = {"high": h < F.greatest(o, c), "low": low > F.least(o, c), "price": (o <= 0) | (c <= 0), "volume": v < 0}
    names = F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in rules.items()]))).alias("rule")
    hits = bars.select(F.concat_ws("@", "ticker", F.col("ts").cast("string")).alias("key"), names)
    nth = Window.partitionBy("rule").orderBy("key")
    few = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    first = hits.withColumn("__k", F.row_number().over(nth)).where("__k <= 5").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("examples"))
    return few.join(first, "rule")


def missing_ranking(panel: DataFrame, x: str = "c", group: str = "ticker") -> DataFrame:
    return panel.groupBy(group).agg(F.count_if(F.col(x).isNull()).alias("missing"))


def tail_mean(df: DataFrame, x: str, share: float = 0.05, group: str = "ticker") -> DataFrame:
    """Mean of the values at or under the given percentile, by group."""
    q = df.groupBy(group).agg(F.percentile(x, share).alias("q"))
    return df.join(q, group).where(F.col(x) <= F.col("q")).groupBy(group).agg(F.max("q").alias("q"), F.avg(x).alias("tail"))


def moments(df: DataFrame, a: str, b: str, group: str = "ticker") -> DataFrame:
    return df.groupBy(group).agg(F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr"))
