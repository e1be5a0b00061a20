"""Queries of events, labels, weights, folds, models and portfolios (A, J, X)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.stage import once, staged
from quantloom.operators import aggregates as A
from quantloom.operators import features as X
from quantloom.operators import fracdiff as D
from quantloom.operators import joins as J
from quantloom.operators import labels as L
from quantloom.operators import metrics as E
from quantloom.operators import models as ML
from quantloom.operators import portfolio as Q
from quantloom.operators import recursive as V
from quantloom.operators import regimes as G
from quantloom.operators import reshape as R
from quantloom.operators import validation as CV

from . import panels as P
from . import windows as WQ
from .registry import query

K = "ticker ts:t"
LABEL = "vertical_ts:t exit_ts:t price:d pt:d sl:d vol:d holding:l exit_price:d hit label:l ret:d"


def events(s, d):
    return V.cusum_events(X.asof_returns(P.bars_w(s, d)))


def labels(s, d, policy: str = "conservative"):
    e = events(s, d).select("ticker", "ts", "vol", F.lit(True).alias("is_event"))
    return L.triple_barrier(P.panel_w(s, d).join(e, ["ticker", "ts"], "left"), policy=policy)


def written_labels(s, d):
    """Labels that a query reads more than once, and several queries share."""
    return once(("labels", d), s, lambda: labels(s, d))


def calendar(s, d):
    return R.calendar(P.bars_w(s, d))


def numbered(df):
    """Labels with their place by time and ticker, from 0, counted by date first."""
    per = df.groupBy("ts").agg(F.count(F.lit(1)).alias("__n"))
    base = per.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    nth = F.row_number().over(Window.partitionBy("ts").orderBy("ticker")) - 1
    return df.withColumn("__i", nth).join(base, "ts").withColumn("label_index", (F.col("__b") + F.col("__i")).cast("long")).drop("__b", "__i")


query("x06_cusum_events", f"{K} price:d ret:d vol:d threshold:d direction", "SELECT * FROM ev", "ev")(events)


def _broken_events(s, d):
    day = F.dayofmonth("ts")
    e = events(s, d).withColumn("threshold", F.when(day % 5 == 0, 0.0).otherwise(F.col("threshold"))).withColumn("vol", F.when(day % 5 != 1, F.col("vol")))
    return e.unionByName(e.where(day == 15))


BROKEN_EVENTS = "(SELECT * FROM be UNION ALL SELECT * FROM be WHERE day(ts) = 15)"
query("x07_event_validation", "rule n:l", f"WITH be AS (SELECT ticker, ts, CASE WHEN day(ts) % 5 = 0 THEN 0 ELSE threshold END AS threshold, CASE WHEN day(ts) % 5 <> 1 THEN vol END AS vol FROM ev) SELECT 'threshold' AS rule, count(*) FILTER (threshold <= 0) AS n FROM {BROKEN_EVENTS} UNION ALL SELECT 'volatility', count(*) FILTER (vol IS NULL) FROM {BROKEN_EVENTS} UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM {BROKEN_EVENTS} GROUP BY ticker, ts HAVING count(*) > 1)", "ev")(
    lambda s, d: L.event_violations(_broken_events(s, d))
)
query("x07_sound_events", "rule n:l", "SELECT 'threshold' AS rule, count(*) FILTER (threshold <= 0) AS n FROM ev UNION ALL SELECT 'volatility', count(*) FILTER (vol IS NULL) FROM ev UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM ev GROUP BY ticker, ts HAVING count(*) > 1)", "ev")(
    lambda s, d: L.event_violations(events(s, d))
)
EVENT_STATS = """SELECT e.ticker, n, n_pos, n_neg, mean_gap, median_gap, min_gap, max_gap, mean_threshold, CASE WHEN days > 0 THEN n / days * 252 ELSE 0 END AS per_year, 100.0 * n_pos / n AS pct_pos FROM (
 SELECT ticker, count(*) AS n, count(*) FILTER (direction = 'Positive') AS n_pos, count(*) FILTER (direction <> 'Positive') AS n_neg, avg(gap) AS mean_gap, quantile_cont(gap, 0.5) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap, avg(threshold) AS mean_threshold
 FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts) AS gap FROM ev) GROUP BY 1) e JOIN (SELECT ticker, CAST(max(ts) - min(ts) AS DOUBLE) AS days FROM bars GROUP BY 1) b USING (ticker)"""
query("a07_event_statistics", "ticker n:l n_pos:l n_neg:l mean_gap:d median_gap:d min_gap:l max_gap:l mean_threshold:d per_year:d pct_pos:d", EVENT_STATS, "ev")(
    lambda s, d: A.event_statistics(events(s, d), P.bars_w(s, d))
)
query("x08_triple_barrier", f"{K} {LABEL}", "SELECT * FROM lab", "lab")(labels)
query("x08_triple_barrier_optimistic", f"{K} exit_ts:t exit_price:d hit label:l", "SELECT * FROM lab", "optimistic")(lambda s, d: labels(s, d, "optimistic"))
query("x08_triple_barrier_ignore", f"{K} exit_ts:t exit_price:d hit label:l", "SELECT * FROM lab", "ignore")(lambda s, d: labels(s, d, "ignore"))
query("x09_label_columns", f"{K} hit label:l", "SELECT * FROM lab", "lab")(labels)


def _broken_labels(s, d):
    """Labels of which each day of the month breaks one rule."""
    k = F.dayofmonth("ts") % 8
    put = lambda n, c, x: F.when(k == n, x).otherwise(F.col(c))
    lab = labels(s, d)
    lab = lab.withColumns({
        "exit_ts": F.when(k == 1, F.date_sub("ts", 1)).when(k == 2, F.date_add("vertical_ts", 1)).otherwise(F.col("exit_ts")), "label": put(3, "label", F.lit(5)), "hit": put(4, "hit", F.lit("XX")),
        "sl": put(5, "sl", F.col("pt")), "price": put(6, "price", F.lit(0.0)), "holding": put(7, "holding", F.lit(-1)),
    })
    return lab.unionByName(lab.where(F.dayofmonth("ts") == 15))


BROKEN_LABELS = """WITH bl AS (SELECT ticker, ts, vertical_ts, pt, CASE day(ts) % 8 WHEN 1 THEN ts - 1 WHEN 2 THEN vertical_ts + 1 ELSE exit_ts END AS exit_ts, CASE WHEN day(ts) % 8 = 3 THEN 5 ELSE label END AS label, CASE WHEN day(ts) % 8 = 4 THEN 'XX' ELSE hit END AS hit,
 CASE WHEN day(ts) % 8 = 5 THEN pt ELSE sl END AS sl, CASE WHEN day(ts) % 8 = 6 THEN 0 ELSE price END AS price, CASE WHEN day(ts) % 8 = 7 THEN -1 ELSE holding END AS holding FROM lab), al AS (SELECT * FROM bl UNION ALL SELECT * FROM bl WHERE day(ts) = 15)"""
RULES = {"exit_before_entry": "exit_ts < ts", "exit_after_vertical": "exit_ts > vertical_ts", "bad_label": "label NOT IN (-1, 0, 1)", "bad_hit": "hit NOT IN ('PT', 'SL', 'VERTICAL')", "barrier_order": "pt <= sl", "price": "price <= 0", "holding": "holding < 0"}
DUPLICATES = "SELECT 'duplicate_key' AS rule, count(*) AS n FROM (SELECT 1 FROM {0} GROUP BY ticker, ts HAVING count(*) > 1)"
query("x10_label_validation", "rule n:l", BROKEN_LABELS + " UNION ALL ".join([*[f" SELECT '{k}' AS rule, count(*) AS n FROM al WHERE {c}" for k, c in RULES.items()], DUPLICATES.format("al")]), "lab")(
    lambda s, d: L.label_violations(_broken_labels(s, d))
)
query("x10_sound_labels", "rule n:l", " UNION ALL ".join([*[f"SELECT '{k}' AS rule, count(*) AS n FROM lab WHERE {c}" for k, c in RULES.items()], DUPLICATES.format("lab")]), "lab")(
    lambda s, d: L.label_violations(labels(s, d))
)
LABEL_STATS = """SELECT ticker, count(*) AS n, count(*) FILTER (hit = 'PT') AS n_pt, count(*) FILTER (hit = 'SL') AS n_sl, count(*) FILTER (hit = 'VERTICAL') AS n_vertical, 100.0 * count(*) FILTER (hit = 'PT') / count(*) AS pct_pt,
 avg(holding) AS mean_holding, quantile_cont(holding, 0.5) AS median_holding, avg(ret) AS mean_ret, quantile_cont(ret, 0.5) AS median_ret, avg(vol) AS mean_vol, CASE WHEN avg(vol) > 0 THEN avg(pt - sl) ELSE 0 END AS mean_width FROM lab GROUP BY 1"""
query("a08_label_statistics", "ticker n:l n_pt:l n_sl:l n_vertical:l pct_pt:d mean_holding:d median_holding:d mean_ret:d median_ret:d mean_vol:d mean_width:d", LABEL_STATS, "lab")(
    lambda s, d: A.label_statistics(labels(s, d))
)
query("a18_concurrency", "ts:t pos:l n:l", "SELECT * FROM conc", "uniq")(lambda s, d: L.concurrency(written_labels(s, d), calendar(s, d)))
query("a19_uniqueness", f"{K} uniqueness:d", "SELECT * FROM uniq", "uniq")(lambda s, d: L.uniqueness(written_labels(s, d), calendar(s, d)))
query("x11_sample_weights", f"{K} uniqueness:d weight:d", "SELECT *, uniqueness * greatest(coalesce(abs(CASE WHEN exit_price / price > 0 THEN ln(exit_price / price) END), 0), 1e-6) AS weight FROM uniq", "uniq")(
    lambda s, d: L.sample_weights(L.uniqueness(written_labels(s, d), calendar(s, d)))
)


def spans(s, d):
    lab, cal = numbered(written_labels(s, d)), calendar(s, d)
    a = cal.select("ts", (F.col("pos") - 1).alias("a"))
    b = cal.select(F.col("ts").alias("exit_ts"), (F.col("pos") - 1).alias("b"))
    return lab.join(a, "ts").join(b, "exit_ts").select("label_index", "a", "b"), cal.count()


def bootstrap(s, d, n: int = 500_000):
    sp, dates = spans(s, d)
    return L.sequential_bootstrap(sp, n, dates)


query("x12_sequential_bootstrap", "label_index:l n_draws:l")(bootstrap)
FOLDS = """WITH i AS (SELECT row_number() OVER (ORDER BY ts, ticker) - 1 AS label_index, ts, exit_ts FROM lab), dd AS (SELECT ts, ntile(5) OVER (ORDER BY ts) AS fold, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM lab)),
ff AS (SELECT fold, min(ts) AS start, max(ts) AS fin, max(k) AS k, max(n) AS n FROM dd GROUP BY 1), f AS (SELECT ff.fold, ff.start, ff.fin AS "end", e.ts AS embargo_end FROM ff JOIN dd e ON e.k = least(ff.n, ff.k + CAST(floor(ff.n * 0.01) AS BIGINT)))"""
query("x13_purged_folds", "label_index:l fold:l split", FOLDS + """ SELECT label_index, fold, CASE WHEN ts BETWEEN start AND "end" THEN 'Test' ELSE 'Train' END AS split FROM i CROSS JOIN f WHERE ts BETWEEN start AND "end" OR NOT ((ts <= "end" AND exit_ts >= start) OR (ts > "end" AND ts <= embargo_end))""", "lab")(
    lambda s, d: CV.purged_folds(numbered(written_labels(s, d)))
)
query("x14_embargo_regions", "fold:l start:t end:t embargo_end:t", FOLDS + " SELECT * FROM f", "lab")(lambda s, d: CV.fold_table(labels(s, d)))


def overlapping(lab):
    """Labels that overlap the test span of each fold; the fold table has as many rows as there are folds."""
    spans_of = F.broadcast(CV.fold_table(lab).withColumnRenamed("end", "stop"))
    return lab.join(spans_of, (F.col("ts") <= F.col("stop")) & (F.col("exit_ts") >= F.col("start"))).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


query("j14_interval_overlap", "fold:l n:l", FOLDS + ' SELECT fold, count(*) AS n FROM i JOIN f ON ts <= "end" AND exit_ts >= start GROUP BY 1', "lab")(
    lambda s, d: overlapping(written_labels(s, d))
)
query("x15_expanding_splits", "fold:l train_end:l test_start:l test_end:l", "SELECT k + 1 AS fold, n - 315 + k * 63 AS train_end, n - 315 + k * 63 AS test_start, n - 315 + (k + 1) * 63 AS test_end FROM (SELECT count(DISTINCT ts) AS n FROM daily) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k)", "d")(
    lambda s, d: s.createDataFrame(CV.expanding_splits(R.calendar(P.bars_d(s, d)).count()), "fold int, train_end int, test_start int, test_end int")
)

# Fractional differences.
query("x01_ffd_weights", "k:l w:d", "WITH RECURSIVE w AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.7 - k) / (k + 1) FROM w WHERE abs(-w * (0.7 - k) / (k + 1)) >= 1e-4) SELECT k, w * 10000 / 3 AS w FROM w")(
    lambda s, d: s.createDataFrame([(k, w * 10_000 / 3) for k, w in enumerate(D.ffd_weights(0.7))], "k int, w double")
)
query("x02_fracdiff", f"{K} fracdiff:d", """WITH RECURSIVE w AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.7 - k) / (k + 1) FROM w WHERE abs(-w * (0.7 - k) / (k + 1)) >= 1e-4),
 r AS (SELECT ticker, ts, c, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM bars), f AS (SELECT a.ticker, a.ts, sum(w.w * b.c) AS x, count(*) AS n FROM r a JOIN w ON true JOIN r b ON b.ticker = a.ticker AND b.i = a.i - w.k GROUP BY 1, 2)
 SELECT ticker, ts, CASE WHEN n = (SELECT count(*) FROM w) THEN x END AS fracdiff FROM f""", "w")(lambda s, d: D.ffd(P.bars_w(s, d), 0.7))  # fmt: skip


def macro_ffill(s, d):
    m = P.macro(s, d).withColumnRenamed("feature", "ticker").withColumnRenamed("value", "c")
    return R.forward_filled(R.densify(m), "c").where("c IS NOT NULL").withColumn("c", C.log(F.col("c")))


query("x03_stationarity", "ticker d:d p_value:d adf_stat:d")(lambda s, d: D.optimal_orders(macro_ffill(s, d)))
query("x04_optimal_order", "ticker d:d p_value:d adf_stat:d")(lambda s, d: D.optimal_orders(P.bars_w(s, d).withColumn("c", F.sum("c").over(C.expanding(C.series())))))
query("x05_fracdiff_by_ticker", f"{K} fracdiff:d")(lambda s, d: D.ffd_by_order(macro_ffill(s, d), D.optimal_orders(macro_ffill(s, d))))

# Metrics over labels: the direction of the event is the prediction.
SCORED = "(SELECT label, CASE WHEN e.direction = 'Positive' THEN 1 ELSE -1 END AS pred, CAST(l.label = CASE WHEN e.direction = 'Positive' THEN 1 ELSE -1 END AS INTEGER) AS y, 1 / (1 + exp(-e.ret)) AS p FROM lab l JOIN ev e ON e.ticker = l.ticker AND e.ts = l.ts)"


def scored(s, d):
    side = F.when(F.col("direction") == "Positive", 1).otherwise(-1)
    e = events(s, d).select("ticker", "ts", F.col("ret").alias("r"), side.alias("pred"))
    j = written_labels(s, d).select("ticker", "ts", "label").join(e, ["ticker", "ts"])
    return j.withColumn("y", (F.col("label") == F.col("pred")).cast("int")).withColumn("p", 1 / (1 + F.exp(-F.col("r"))))


def _scores(s, d):
    c = E.classification(scored(s, d))
    return s.createDataFrame([(k, float(v)) for k, v in c.items() if k in ("accuracy", "balanced_accuracy", "mcc")], "metric string, value double")


query("a21_classification", "metric value:d", f"""WITH s AS {SCORED}, n AS (SELECT count(*) AS n, count(*) FILTER (label = pred) AS ok FROM s), t AS (SELECT label AS k, count(*) AS t, count(*) FILTER (label = pred) AS g FROM s GROUP BY 1), p AS (SELECT pred AS k, count(*) AS p FROM s GROUP BY 1)
 SELECT 'accuracy' AS metric, ok / n AS value FROM n UNION ALL SELECT 'balanced_accuracy', avg(g / t) FROM t
 UNION ALL SELECT 'mcc', (max(ok) * max(n) - sum(t * coalesce(p, 0))) / sqrt(CAST(max(n) * max(n) - (SELECT sum(p * p) FROM p) AS DOUBLE) * (max(n) * max(n) - sum(t * t))) FROM n, t LEFT JOIN p USING (k)""", "lab")(_scores)  # fmt: skip
query("a21_per_class", "class:l precision:d recall:d f1:d support:l", f"""WITH s AS {SCORED}, t AS (SELECT label AS k, count(*) AS t, count(*) FILTER (label = pred) AS g FROM s GROUP BY 1), p AS (SELECT pred AS k, count(*) AS p FROM s GROUP BY 1),
 m AS (SELECT k, coalesce(t, 0) AS t, CASE WHEN coalesce(p, 0) > 0 THEN coalesce(g, 0) / p ELSE 0 END AS pr, CASE WHEN coalesce(t, 0) > 0 THEN g / t ELSE 0 END AS re FROM t FULL JOIN p USING (k))
 SELECT k AS class, pr AS precision, re AS recall, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, t AS support FROM m""", "lab")(lambda s, d: E.per_class(scored(s, d)))  # fmt: skip
KEPT = f"(SELECT y, p, CAST(p > 0.5 AS INTEGER) AS pred FROM {SCORED})"


def kept(s, d):
    return scored(s, d).withColumn("pred", (F.col("p") > 0.5).cast("int"))


query("a22_binary_metrics", "accuracy:d precision:d recall:d f1:d", f"SELECT a AS accuracy, p AS precision, r AS recall, 2 * p * r / (p + r) AS f1 FROM (SELECT count(*) FILTER (y = pred) / count(*) AS a, count(*) FILTER (y = 1 AND pred = 1) / count(*) FILTER (pred = 1) AS p, count(*) FILTER (y = 1 AND pred = 1) / count(*) FILTER (y = 1) AS r FROM {KEPT})", "lab")(
    lambda s, d: E.binary(kept(s, d))
)
query("a23_calibration", "brier:d log_loss:d auc:d", f"WITH k AS {KEPT}, r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM k) SELECT avg((p - y) * (p - y)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r", "lab")(
    lambda s, d: E.calibration(scored(s, d))
)
query("a24_profit_lift", "n:l n_kept:l base:d filtered:d lift:d retention:d", f"SELECT count(*) AS n, sum(pred) AS n_kept, avg(y) AS base, avg(y) FILTER (pred = 1) AS filtered, avg(y) FILTER (pred = 1) - avg(y) AS lift, sum(pred) / count(*) AS retention FROM {KEPT}", "lab")(
    lambda s, d: E.profit_lift(kept(s, d))
)
query("x23_meta_labels", "y:l n:l", f"SELECT y, count(*) AS n FROM {SCORED} GROUP BY 1", "lab")(
    lambda s, d: ML.meta_labels(scored(s, d).select("pred", F.col("label").alias("y"))).groupBy(F.col("meta_label").alias("y")).agg(F.count(F.lit(1)).alias("n"))
)

# Expected returns, costs, benchmarks.
query("a25_conditional_payoffs", "ts:t up:d down:d", "SELECT c.ts, coalesce(avg(l.ret) FILTER (l.label = 1), 0.05) AS up, coalesce(avg(-l.ret) FILTER (l.label = -1), 0.05) AS down FROM cal c LEFT JOIN lab l ON l.exit_ts < c.ts GROUP BY 1", "lab")(
    lambda s, d: Q.conditional_payoffs(labels(s, d), calendar(s, d))
)
query("x25_expected_returns", f"{K} mu:d", f"""SELECT e.ticker, e.ts, CASE WHEN e.direction = 'Positive' THEN p.up ELSE -p.down END * (2 / (1 + exp(-e.ret)) - 1) AS mu FROM ev e JOIN (SELECT c.ts, coalesce(avg(l.ret) FILTER (l.label = 1), 0.05) AS up, coalesce(avg(-l.ret) FILTER (l.label = -1), 0.05) AS down FROM cal c LEFT JOIN lab l ON l.exit_ts < c.ts GROUP BY 1) p USING (ts)
 JOIN lab b ON b.ticker = e.ticker AND b.ts = e.ts""", "lab")(lambda s, d: Q.expected_returns(scored(s, d).withColumn("direction", F.col("pred")), Q.conditional_payoffs(labels(s, d), calendar(s, d))))  # fmt: skip


def returns(s, d, every=WQ._pct):
    return every(s, d).select("ticker", "ts", (F.col("r") / 100).alias("ret"))


R1 = "(SELECT ticker, ts, (c / lag(c) OVER (PARTITION BY ticker ORDER BY ts) - 1) / 100 AS r FROM panel)"
query("a26_sample_covariance", "a b cov:d n:l", f"WITH r AS {R1} SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.r, y.r) AS cov, count(*) AS n FROM r x JOIN r y ON x.ts = y.ts AND y.ticker >= x.ticker WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2", "w")(
    lambda s, d: Q.sample_covariance(returns(s, d))
)


# The sums of Ledoit-Wolf and OAS written out; prices of a ticker are returns over all dates, nulls as zero.
SHRUNK = f"""WITH r AS (SELECT ticker, ts, r * 100 AS r FROM {R1}), k AS (SELECT count(DISTINCT ts) AS n, count(DISTINCT ticker) AS p FROM r),
 z AS (SELECT ticker, ts, coalesce(r, 0) - avg(coalesce(r, 0)) OVER (PARTITION BY ticker) AS z FROM r),
 c AS (SELECT x.ticker AS a, y.ticker AS b, sum(x.z * y.z) / max(n) AS s, sum(x.z * x.z * y.z * y.z) / max(n) AS q FROM z x JOIN z y ON x.ts = y.ts CROSS JOIN k GROUP BY 1, 2),
 g AS (SELECT max(n) AS n, max(p) AS p, sum(s) FILTER (a = b) / max(p) AS mu, sum(s * s) AS ss, sum(q) AS qq FROM c CROSS JOIN k),
 h AS (SELECT *, (SELECT sum(pow(s - CASE WHEN a = b THEN mu ELSE 0 END, 2)) FROM c) / p AS delta, (n + 1) * (ss / (p * p) - mu * mu / p) AS den FROM g),
 w AS (SELECT mu, least(delta, (qq - ss) / (p * n)) / delta AS lw, least(1, (ss / (p * p) + mu * mu) / den) AS oas FROM h)
 SELECT a, b, s + CASE WHEN a = b THEN 1e-6 ELSE 0 END AS sample, (1 - lw) * s + CASE WHEN a = b THEN lw * mu + 1e-6 ELSE 0 END AS ledoit_wolf, (1 - oas) * s + CASE WHEN a = b THEN oas * mu + 1e-6 ELSE 0 END AS oas FROM c, w WHERE a <= b"""
query("a26_shrunk_covariance", "a b sample:d ledoit_wolf:d oas:d", SHRUNK, "w")(lambda s, d: Q.shrunk_covariance(returns(s, d).withColumn("ret", F.col("ret") * 100)))


def optimised(s, d):
    """Weights for each objective over the whole window. The solver's task gets the covariance and means of the tickers, not their returns."""
    out = "objective string, ticker string, w double"
    r = returns(s, d)
    pairs = Q.shrunk_covariance(r).select("a", "b", "ledoit_wolf")
    rows = pairs.join(r.groupBy(F.col("ticker").alias("a")).agg(F.avg("ret").alias("mu")), "a")

    def run(pdf):
        import pandas as pd

        n = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {t: i for i, t in enumerate(n)}
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        cov, mu = np.zeros((len(n), len(n))), np.zeros(len(n))
        cov[i, j] = cov[j, i] = pdf["ledoit_wolf"]
        mu[i] = pdf["mu"]
        rows = []
        for k in ("max_sharpe", "min_variance", "risk_parity", "return"):
            w = Q.optimise(mu, cov, np.full(len(n), 1 / len(n)), Q.Limits(cap=0.10, objective=k))
            rows += [(k, n[i], float(w[i])) for i in range(len(n))]
        return pd.DataFrame(rows, columns=["objective", "ticker", "w"])

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, out)


query("x26_portfolio_weights", "objective ticker w:d")(optimised)


def weights(s, d):
    return P.panel_w(s, d).withColumn("w", F.coalesce("v", F.lit(0.0)) / 1000).select("ticker", "ts", "w")


query("x27_transaction_costs", "ts:t turnover:d commission:d slippage:d spread:d total:d", """WITH w AS (SELECT ticker, ts, coalesce(v, 0) / 1000 AS w, lag(coalesce(v, 0) / 1000) OVER (PARTITION BY ticker ORDER BY ts) AS o FROM panel), t AS (SELECT ts, sum(abs(w - coalesce(o, 0))) AS t FROM w GROUP BY 1)
 SELECT ts, t AS turnover, t * 100 AS commission, t * 500 AS slippage, t * 100 AS spread, t * 700 AS total FROM t""", "w")(
    lambda s, d: Q.transaction_costs(weights(s, d).withColumn("w", F.lag("w").over(C.series())).where("w IS NOT NULL"), weights(s, d), 1e6)
)
query("x28_rebalance_dates", "ts:t", "SELECT max(ts) AS ts FROM dcal GROUP BY date_trunc('month', ts)", "d")(lambda s, d: Q.rebalance_dates(R.calendar(P.bars_d(s, d))))
query("x28_rebalance_dates_exact", "ts:t", "SELECT ts FROM dcal WHERE ts = last_day(ts)", "d")(lambda s, d: Q.rebalance_dates(R.calendar(P.bars_d(s, d)), exact=True))
query("x30_benchmarks", "ts:t equal:d inverse_variance:d inverse_std:d", f"""WITH r AS {R1}, s AS (SELECT ticker, var_samp(r) AS v FROM r GROUP BY 1), k AS (SELECT ticker, (1 / v) / sum(1 / v) OVER () AS wv, (1 / sqrt(v)) / sum(1 / sqrt(v)) OVER () AS ws FROM s WHERE v > 0),
 dd AS (SELECT ts, avg(coalesce(r, 0)) AS e, sum(coalesce(r, 0) * coalesce(wv, 0)) AS v, sum(coalesce(r, 0) * coalesce(ws, 0)) AS q FROM r LEFT JOIN k USING (ticker) GROUP BY 1)
 SELECT ts, exp(sum(ln(1 + e)) OVER (ORDER BY ts)) AS equal, exp(sum(ln(1 + v)) OVER (ORDER BY ts)) AS inverse_variance, exp(sum(ln(1 + q)) OVER (ORDER BY ts)) AS inverse_std FROM dd""", "w")(lambda s, d: Q.benchmarks(returns(s, d)))  # fmt: skip


# Four named windows over the years of the tables: all of them, the first, the middle and the last ones.
PERIODS = {"full_history": ("1995-01-01", "2001-12-31"), "early": ("1995-01-01", "1998-12-31"), "middle": ("1998-01-01", "2000-12-31"), "recent": ("2001-01-01", "2001-12-31")}


def expected(s, d):
    """Expected returns of the chain of models: direction of the primary model, probability of the meta model, payoffs known by then."""
    primary = predictions(s, d).select("label_index", (F.col("pred") - 1).alias("direction"))
    second = meta(s, d).select("label_index", "p")
    rows = master(s, d).select("label_index", "ticker", "ts").join(primary, "label_index").join(second, "label_index", "left")
    return Q.expected_returns(rows, Q.conditional_payoffs(written_labels(s, d), calendar(s, d))).select("ticker", "ts", "mu")


def backtest_rows(s, d):
    """Returns with expected returns and the last regime at or before each date, once for each named period."""
    known = regimes(s, d).select("ts", F.col("regime_label").alias("regime"))
    regime = J.asof(calendar(s, d).select("ts"), known, "regime", default=1)
    both = returns(s, d).join(expected(s, d), ["ticker", "ts"], "left").join(regime, "ts")
    period = F.explode(F.array_compact(F.array(*[F.when(F.col("ts") <= F.lit(b).cast("date"), F.struct(F.lit(k).alias("period"), (F.col("ts") >= F.lit(a).cast("date")).alias("in"))) for k, (a, b) in PERIODS.items()]))).alias("x")
    # Days before a period stay, without expected returns, for the covariance of its first days.
    return both.select("*", period).select("ts", "ticker", "ret", F.when(F.col("x.in"), F.col("mu")).alias("mu"), "regime", "x.period")


def backtest(s, d, part: str = "equity"):
    rows = once(("backtest", d), s, lambda: backtest_rows(s, d))
    return Q.Backtest().run(rows, Q.rebalance_dates(calendar(s, d)), part)


query("x29_backtest_equity", "period ts:t gross:d net:d")(backtest)
query("x29_backtest_turnover", "period ts:t turnover:d cost:d value:d")(lambda s, d: backtest(s, d, "turnover"))
query("x29_backtest_weights", "period ts:t ticker w:d")(lambda s, d: backtest(s, d, "weights"))


def comparison(s, d):
    out = None
    bench = staged(Q.benchmarks(returns(s, d)).select("ts", F.col("equal").alias("bench")))
    equity, turnover = (staged(backtest(s, d, part)) for part in ("equity", "turnover"))
    for k in PERIODS:
        e = equity.where(F.col("period") == k).drop("period")
        t = turnover.where(F.col("period") == k).drop("period")
        row = E.performance(e, t, bench).withColumn("period", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


ALL_METRICS = "gross_cagr:d cagr:d cost_drag:d annual_return:d volatility:d sharpe:d sortino:d max_drawdown:d calmar:d information_ratio:d alpha:d beta:d total_cost:d annual_turnover:d mean_turnover:d win_rate:d holding_days:d"
PERF = """WITH e AS (SELECT ts, m1 AS gross, m5 AS net, m2 AS bench, m3, m4 FROM (SELECT ts, """ + ", ".join(f"max(value) FILTER (feature = 'm{k}') AS m{k}" for k in range(1, 6)) + """ FROM macro GROUP BY 1) WHERE m1 + m2 + m3 + m4 + m5 IS NOT NULL),
 x AS (SELECT *, net / lag(net) OVER (ORDER BY ts) - 1 AS r, bench / lag(bench) OVER (ORDER BY ts) - 1 AS b, net / max(net) OVER (ORDER BY ts) - 1 AS dd FROM e),
 t AS (SELECT ts, turnover, cost, ts - lag(ts) OVER (ORDER BY ts) AS gap FROM (SELECT max(ts) AS ts, avg(m3) / 1e6 AS turnover, sum(m4) / 100 AS cost FROM e GROUP BY date_trunc('month', ts))),
 u AS (SELECT avg(turnover) AS mean_turnover, sum(cost) AS total_cost, avg(turnover) * 252 / avg(gap) AS annual_turnover FROM t),
 g AS (SELECT pow(arg_max(gross, ts) / arg_min(gross, ts), 365.25 / (max(ts) - min(ts))) - 1 AS gross_cagr, pow(arg_max(net, ts) / arg_min(net, ts), 365.25 / (max(ts) - min(ts))) - 1 AS cagr, pow(arg_max(bench, ts) / arg_min(bench, ts), 365.25 / (max(ts) - min(ts))) - 1 AS bench_cagr,
  stddev_samp(r) * sqrt(252) AS volatility, avg(r) * 252 AS mean, stddev_samp(r) FILTER (r < 0) * sqrt(252) AS down, min(dd) AS max_drawdown, avg(CAST(r > 0 AS INTEGER)) AS win_rate, covar_samp(r, b) / var_pop(b) FILTER (r IS NOT NULL) AS beta, avg(b) * 252 AS mean_b, stddev_samp(r - b) * sqrt(252) AS te FROM x)
 SELECT gross_cagr, cagr, gross_cagr - cagr AS cost_drag, cagr AS annual_return, volatility, mean / volatility AS sharpe, mean / down AS sortino, max_drawdown, cagr / abs(max_drawdown) AS calmar, (cagr - bench_cagr) / te AS information_ratio, mean - beta * mean_b AS alpha, beta,
  total_cost, annual_turnover, mean_turnover, win_rate, 252 / annual_turnover AS holding_days FROM g, u"""


def _perf(s, d):
    """The metrics of one series, with the costs and turnover of each month made from two more."""
    names = [f"m{k}" for k in range(1, 6)]
    m = R.pivot(P.macro(s, d), "ts", "feature", "value", names).na.drop(subset=names)
    t = m.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.max("ts").alias("ts"), (F.avg("m3") / 1e6).alias("turnover"), (F.sum("m4") / 100).alias("cost"))
    return E.performance(m.select("ts", F.col("m1").alias("gross"), F.col("m5").alias("net")), t.select("ts", "turnover", "cost"), m.select("ts", F.col("m2").alias("bench")))


query("a20_performance", ALL_METRICS, PERF, "m")(_perf)
query("x31_period_comparison", f"period {ALL_METRICS}")(comparison)


def series_of(s, d, k):
    return P.macro(s, d).where(F.col("feature") == k).select("ts", "value")


query("x32_spreads", "ts:t feature value:d", " UNION ALL ".join(f"SELECT a.ts, '{a}_{b}' AS feature, a.value - b.value AS value FROM macro a JOIN macro b ON a.ts = b.ts AND a.feature = '{a}' AND b.feature = '{b}'" for a, b in (("m1", "m2"), ("m1", "m3"), ("m4", "m1"))), "m")(
    lambda s, d: Q.spread(series_of(s, d, "m1"), series_of(s, d, "m2"), "m1_m2").unionByName(Q.spread(series_of(s, d, "m1"), series_of(s, d, "m3"), "m1_m3")).unionByName(Q.spread(series_of(s, d, "m4"), series_of(s, d, "m1"), "m4_m1"))
)
query("x33_combined_table", "ts:t m1:d m2:d m3:d m4:d m5:d", "SELECT ts, " + ", ".join(f"max(value) FILTER (feature = 'm{k}') AS m{k}" for k in range(1, 6)) + " FROM macro GROUP BY ts", "m")(
    lambda s, d: R.pivot(P.macro(s, d), "ts", "feature", "value", [f"m{k}" for k in range(1, 6)])
)

# Regimes and models.
REGIME = ["r1", "r2", "r3"]


def macro_returns(s, d):
    m = R.pivot(P.macro(s, d), "ts", "feature", "value", ["m1", "m2", "m3"])
    w = Window.orderBy("ts")
    return m.select("ts", *[C.log(C.ratio(F.col(f"m{k}"), F.lag(f"m{k}").over(w))).alias(f"r{k}") for k in (1, 2, 3)])


def regimes(s, d):
    """Written once: five queries read them, and a refit of all dates takes long."""
    return once(("regimes", d), s, lambda: G.expanding_regimes(macro_returns(s, d), REGIME))


query("x16_expanding_regimes", "ts:t regime_0_prob:d regime_1_prob:d regime_2_prob:d regime_label:l")(regimes)
query("x18_regime_diagnostics", "regime_label:l days:l total_variance:d r1_mean:d r2_mean:d r3_mean:d stay_share:d")(lambda s, d: G.regime_diagnostics(regimes(s, d), macro_returns(s, d), REGIME))


MODEL = ["log_ret_1d", "log_ret_5d", "roc_20d", "price_to_sma_20d", "rel_vol_20d"]


def master(s, d):
    """The training set: labels with features and draws; written once, since every model and fold reads it."""

    def build():
        f = X.volume(X.momentum(X.log_returns(P.panel_w(s, d), (5, 20)), (5, 20)))
        lab = numbered(L.sample_weights(L.uniqueness(written_labels(s, d), calendar(s, d))))
        rows = ML.training_set(lab, f.select("ticker", "ts", *MODEL)).withColumn("y", R.class_index(F.col("label")))
        return rows.join(bootstrap(s, d), "label_index", "left").withColumn("w", F.coalesce("n_draws", F.lit(0)) * F.col("weight"))

    return once(("master", d), s, build)


def fitted(s, d, name: str):
    m = master(s, d)
    folds = staged(CV.purged_folds(m.select("label_index", "ts", "exit_ts")))
    return ML.train_and_infer(m.select("label_index", "y", "w", *MODEL), folds, MODEL, name)


def predictions(s, d):
    """Out-of-sample predictions of the primary model, written once."""
    return once(("predictions", d), s, lambda: fitted(s, d, "logistic"))


query("x22_out_of_sample_predictions", "label_index:l fold:l y:l pred:l")(predictions)


def meta(s, d):
    def build():
        p = ML.meta_labels(predictions(s, d)).select("label_index", "fold", F.col("meta_label").alias("y"), F.array_max("probs").alias("p_best"))
        rows = staged(p.join(master(s, d).select("label_index", *MODEL), "label_index"))
        return ML.meta_infer(rows, [*MODEL, "p_best"])

    return once(("meta", d), s, build)


query("x24_meta_predictions", "label_index:l fold:l y:l p:d pred:l")(meta)

# Scaler, state order, further models.
query("x19_standard_scaler", "ts:t z1:d z2:d", "SELECT ts, (m1 - avg(m1) OVER ()) / stddev_pop(m1) OVER () AS z1, (m2 - avg(m2) OVER ()) / stddev_pop(m2) OVER () AS z2 FROM (SELECT ts, max(value) FILTER (feature = 'm1') AS m1, max(value) FILTER (feature = 'm2') AS m2 FROM macro GROUP BY 1)", "m")(
    lambda s, d: G.standardised(R.pivot(P.macro(s, d), "ts", "feature", "value", ["m1", "m2"]), {"m1": "z1", "m2": "z2"})
)
query("x17_state_order", "state:l total_variance:d place:l")(
    lambda s, d: G.regime_diagnostics(regimes(s, d), macro_returns(s, d), REGIME).select(F.col("regime_label").alias("state"), "total_variance", F.row_number().over(Window.orderBy("total_variance")).alias("place"))
)
query("j09_asof_strict", f"{K} prev_ts:t", "SELECT b.ticker, b.ts, p.ts AS prev_ts FROM daily b ASOF JOIN daily p ON b.ticker = p.ticker AND b.ts - INTERVAL 1 DAY > p.ts", "d")(lambda s, d: X.asof_returns(P.bars_d(s, d)))


query("x20_random_forest", "label_index:l fold:l y:l pred:l")(lambda s, d: fitted(s, d, "forest"))
query("x20_boosted_trees", "label_index:l fold:l y:l pred:l")(lambda s, d: fitted(s, d, "boosted"))
query("x34_perceptron", "label_index:l fold:l y:l pred:l")(lambda s, d: fitted(s, d, "perceptron"))


def silhouette(s, d):
    r = staged(regimes(s, d).select("ts", "regime_label").join(macro_returns(s, d), "ts").na.drop())
    return G.silhouette(r, REGIME, "regime_label")


query("x35_silhouette", "metric value:d")(silhouette)
query("x21_fold_training_rows", "fold:l n:l draws:l")(
    lambda s, d: CV.purged_folds(numbered(written_labels(s, d))).where("split = 'Train'").join(bootstrap(s, d), "label_index").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("n_draws").alias("draws"))
)
query("w09_bollinger", f"{K} mid:d upper:d lower:d", f"SELECT ticker, ts, m AS mid, m + 2 * sd AS upper, m - 2 * sd AS lower FROM (SELECT *, {WQ.roll('avg', 'c', 20)} AS m, {WQ.roll('stddev_samp', 'c', 20)} AS sd FROM (SELECT ticker, ts, c / 1000 AS c FROM panel))", "w")(
    lambda s, d: X.bollinger(P.panel_w(s, d).withColumn("c", F.col("c") / 1000))
)


# The chain from returns to labels over a panel as wide as there are parts.
def wide_events(s, d):
    return V.cusum_events(X.asof_returns(P.bars_p(s, d)))


def wide_labels(s, d):
    bars = once(("wide_bars", d), s, lambda: P.bars_p(s, d))
    e = once(("wide_events", d), s, lambda: V.cusum_events(X.asof_returns(bars))).select("ticker", "ts", "vol", F.lit(True).alias("is_event"))
    return L.triple_barrier(R.densify(bars).join(e, ["ticker", "ts"], "left"))


query("wide_asof_returns", f"{K} ret:d", "SELECT * FROM ret", "wide")(lambda s, d: X.asof_returns(P.bars_p(s, d)))
query("wide_daily_volatility", f"{K} vol:d", "SELECT * FROM vol", "wide")(lambda s, d: V.by_series(X.asof_returns(P.bars_p(s, d)), {"vol": ("ret", lambda x, starts: V.ewm_std(x, 100, starts))}))
query("wide_cusum_events", f"{K} threshold:d direction", "SELECT * FROM ev", "wide")(wide_events)
query("wide_triple_barrier", f"{K} vertical_ts:t exit_ts:t pt:d sl:d vol:d holding:l hit label:l ret:d", "SELECT * FROM lab", "wide")(wide_labels)
