"""Queries of window features (W) and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.operators import features as X
from quantloom.operators import recursive as V
from quantloom.operators import reshape as R

from . import panels as P
from .registry import BODIES, query

K = "ticker ts:t"
W = "OVER (PARTITION BY ticker ORDER BY ts)"
H = X.HORIZONS


def roll(agg: str, x: str, n: int, shift: int = 0) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


def logsql(e: str) -> str:
    return f"CASE WHEN {e} > 0 THEN ln({e}) END"


query("w01_lag", f"{K} lag1:d lag5:d", f"SELECT *, lag(c) {W} AS lag1, lag(c, 5) {W} AS lag5 FROM panel", "w")(
    lambda s, d: P.panel_w(s, d).withColumns({"lag1": F.lag("c").over(C.series()), "lag5": F.lag("c", 5).over(C.series())})
)
query("w02_lead", f"{K} next:d", f"SELECT *, lead(c) {W} AS next FROM panel", "w")(lambda s, d: P.panel_w(s, d).withColumn("next", F.lead("c").over(C.series())))
query("w03_log_returns", f"{K} " + " ".join(f"log_ret_{k}d:d" for k in (1, *H)), "SELECT *, " + ", ".join(f"{logsql(f'c / lag(c, {k}) {W}')} AS log_ret_{k}d" for k in (1, *H)) + " FROM panel", "w")(
    lambda s, d: X.log_returns(P.panel_w(s, d))
)
query(
    "w04_rolling_ranges", f"{K} " + " ".join(f"rolling_high_{k}d:d rolling_low_{k}d:d rolling_range_{k}d:d" for k in H),
    "SELECT *, " + ", ".join(f"({roll('max', 'h', k)}) / c - 1 AS rolling_high_{k}d, ({roll('min', 'l', k)}) / c - 1 AS rolling_low_{k}d, (({roll('max', 'h', k)}) - ({roll('min', 'l', k)})) / c AS rolling_range_{k}d" for k in H) + " FROM panel", "w",
)(lambda s, d: X.price_ranges(P.panel_w(s, d)))
query("w05_breakout", f"{K} " + " ".join(f"breakout_{k}d:d" for k in H), "SELECT *, " + ", ".join(f"(c - ({roll('max', 'h', k, 1)})) / c AS breakout_{k}d" for k in H) + " FROM panel", "w")(
    lambda s, d: X.price_ranges(P.panel_w(s, d))
)
query("w06_rate_of_change", f"{K} " + " ".join(f"roc_{k}d:d" for k in H), "SELECT *, " + ", ".join(f"c / lag(c, {k}) {W} - 1 AS roc_{k}d" for k in H) + " FROM panel", "w")(
    lambda s, d: X.momentum(P.panel_w(s, d))
)
query(
    "w07_price_to_sma", f"{K} " + " ".join(f"price_to_sma_{k}d:d" for k in H) + " sma_cross_5_20:d",
    "SELECT *, " + ", ".join(f"c / ({roll('avg', 'c', k)}) - 1 AS price_to_sma_{k}d" for k in H) + f", ({roll('avg', 'c', 5)}) / ({roll('avg', 'c', 20)}) - 1 AS sma_cross_5_20 FROM panel", "w",
)(lambda s, d: X.momentum(P.panel_w(s, d)))
RET1 = f"(SELECT *, {logsql(f'c / lag(c) {W}')} AS r FROM panel)"
query("w08_realised_volatility", f"{K} " + " ".join(f"realized_vol_{k}d:d" for k in H), "SELECT *, " + ", ".join(f"({roll('stddev_samp', 'r', k)}) * sqrt(252) AS realized_vol_{k}d" for k in H) + f" FROM {RET1}", "w")(
    lambda s, d: X.realised_volatility(P.panel_w(s, d))
)


def _ewma_vol(s, d):
    df = P.panel_w(s, d).withColumn("r", C.log(C.ratio(F.col("c"), F.lag("c").over(C.series()))))
    cols = {f"ewma_vol_{k}d": ("r", lambda x, starts, k=k: V.ewm_std(x, k, starts) * X.YEAR) for k in H}
    return V.by_series(df, cols)


def ewm_sql(k: int) -> str:
    decay = f"pow(1 - 2 / ({k} + 1.0), a.pos - b.pos)"
    return f"""(SELECT a.ticker, a.pos, sqrt(greatest(sum({decay} * b.r * b.r) / sum({decay}) - pow(sum({decay} * b.r) / sum({decay}), 2), 0)
      * pow(sum({decay}), 2) / nullif(pow(sum({decay}), 2) - sum({decay} * {decay}), 0)) * sqrt(252) AS x, count(*) AS n FROM r1 a JOIN r1 b ON a.ticker = b.ticker AND b.pos <= a.pos AND b.r IS NOT NULL GROUP BY 1, 2)"""


query(
    "w09_ewma_volatility", f"{K} " + " ".join(f"ewma_vol_{k}d:d" for k in H),
    f"WITH r1 AS {RET1} SELECT p.ticker, p.ts, " + ", ".join(f"CASE WHEN e{k}.n > 1 THEN e{k}.x END AS ewma_vol_{k}d" for k in H) + " FROM r1 p " + " ".join(f"LEFT JOIN {ewm_sql(k)} e{k} ON e{k}.ticker = p.ticker AND e{k}.pos = p.pos" for k in H), "w",
)(_ewma_vol)
TR = f"(SELECT *, greatest(h - l, abs(h - lag(c) {W}), abs(l - lag(c) {W})) AS true_range FROM panel)"
query("w10_average_true_range", f"{K} true_range:d atr_14d_norm:d", f"SELECT *, ({roll('avg', 'true_range', 14)}) / c AS atr_14d_norm FROM {TR}", "w")(lambda s, d: X.average_true_range(P.panel_w(s, d)))


def ema_step(x: str, span: int) -> str:
    a = f"(2 / ({span} + 1.0))"
    aged = f"g_{x} * CASE WHEN y_{x} IS NULL THEN 1 ELSE 1 - {a} END"
    return aged, f"CASE WHEN v IS NULL THEN y_{x} WHEN y_{x} IS NULL THEN v ELSE ({aged} * y_{x} + {a} * v) / ({aged} + {a}) END", f"CASE WHEN v IS NULL THEN {aged} ELSE 1 END"


def _macd_sql() -> str:
    fa, fy, fg = ema_step("f", 12)
    sa, sy, sg = ema_step("s", 26)
    ma, my, mg = ema_step("m", 9)
    return f"""WITH RECURSIVE e1 AS (
      SELECT ticker, pos, c AS y_f, CAST(1 AS DOUBLE) AS g_f, c AS y_s, CAST(1 AS DOUBLE) AS g_s FROM panel WHERE pos = 1
      UNION ALL SELECT ticker, pos, {fy}, {fg}, {sy}, {sg} FROM (SELECT e1.ticker, p.pos, p.c AS v, y_f, g_f, y_s, g_s FROM e1 JOIN panel p ON p.ticker = e1.ticker AND p.pos = e1.pos + 1)),
    e2 AS (SELECT ticker, pos, y_f - y_s AS v FROM e1 WHERE pos = 1), line AS (SELECT ticker, pos, y_f - y_s AS line FROM e1),
    e3 AS (SELECT ticker, pos, v AS y_m, CAST(1 AS DOUBLE) AS g_m FROM e2
      UNION ALL SELECT ticker, pos, {my}, {mg} FROM (SELECT e3.ticker, l.pos, l.line AS v, y_m, g_m FROM e3 JOIN line l ON l.ticker = e3.ticker AND l.pos = e3.pos + 1))
    SELECT p.ticker, p.ts, l.line / p.c AS macd, e3.y_m / p.c AS macd_signal, (l.line - e3.y_m) / p.c AS macd_hist FROM panel p JOIN line l USING (ticker, pos) JOIN e3 USING (ticker, pos)"""


query("w11_macd", f"{K} macd:d macd_signal:d macd_hist:d", _macd_sql(), "w")(lambda s, d: V.macd(P.panel_w(s, d)))
query(
    "w12_volume", f"{K} vol_ma_20d:d rel_vol_20d:d vol_zscore_20d:d vol_momentum:d",
    f"SELECT *, m AS vol_ma_20d, v / nullif(m, 0) AS rel_vol_20d, (v - m) / nullif(sd, 0) AS vol_zscore_20d, m5 / nullif(m, 0) AS vol_momentum FROM (SELECT *, {roll('avg', 'v', 20)} AS m, {roll('stddev_samp', 'v', 20)} AS sd, {roll('avg', 'v', 5)} AS m5 FROM panel)", "w",
)(lambda s, d: X.volume(P.panel_w(s, d)))
query(
    "w13_cross_asset", f"{K} rel_ret_Brand#1:d rs_Brand#1_20d:d",
    f"""WITH s AS (SELECT *, {logsql(f'c / lag(c) {W}')} AS r, c / lag(c, 20) {W} AS g FROM panel)
    SELECT s.ticker, s.ts, s.r - b.r AS "rel_ret_Brand#1", s.g / b.g - 1 AS "rs_Brand#1_20d" FROM s LEFT JOIN s b ON b.ts = s.ts AND b.ticker = 'Brand#1'""", "w",
)(lambda s, d: X.cross_asset(P.panel_w(s, d), ["Brand#1"]))
query(
    "w14_asof_returns", f"{K} prev_ts:t ret:d",
    "SELECT b.ticker, b.ts, p.ts AS prev_ts, CASE WHEN b.c / p.c > 0 THEN ln(b.c / p.c) END AS ret FROM daily b ASOF JOIN daily p ON b.ticker = p.ticker AND b.ts - INTERVAL 1 DAY > p.ts", "d",
)(lambda s, d: X.asof_returns(P.bars_d(s, d)))


def with_vol(s, d):
    return V.by_series(X.asof_returns(P.bars_w(s, d)), {"vol": ("ret", lambda x, starts: V.ewm_std(x, 100, starts))})


query("w15_daily_volatility", f"{K} vol:d", "SELECT * FROM vol", "ret")(with_vol)
query("w16_pct_change", f"{K} pct:d", f"SELECT *, c / lag(c) {W} - 1 AS pct FROM panel", "w")(lambda s, d: P.panel_w(s, d).withColumn("pct", C.ratio(F.col("c"), F.lag("c").over(C.series())) - 1))
query("w17_drawdown", f"{K} cummax:d drawdown:d", f"SELECT *, (c - cummax) / cummax AS drawdown FROM (SELECT *, max(c) {W} AS cummax FROM panel)", "w")(lambda s, d: X.drawdown(P.panel_w(s, d)))


def _pct(s, d):
    return P.panel_w(s, d).withColumn("r", C.ratio(F.col("c"), F.lag("c").over(C.series())) - 1)


PCT = f"(SELECT *, c / lag(c) {W} - 1 AS r FROM panel)"
query(
    "w18_rolling_performance", f"{K} roll_ret:d roll_vol:d roll_sharpe:d",
    f"SELECT *, a * 252 AS roll_ret, b * sqrt(252) AS roll_vol, a * 252 / (b * sqrt(252) + 1e-6) AS roll_sharpe FROM (SELECT *, {roll('avg', 'r', 126)} AS a, {roll('stddev_samp', 'r', 126)} AS b FROM {PCT})", "w",
)(lambda s, d: X.rolling_performance(_pct(s, d), "r"))
query("w19_equity_curve", f"{K} equity:d", f"SELECT *, exp(sum(ln(1 + coalesce(r, 0) / 10000)) {W}) AS equity FROM {PCT}", "w")(
    lambda s, d: X.equity_curve(_pct(s, d).withColumn("r", F.col("r") / 10000), "r")
)
query("w20_cumulative_sum", f"{K} total:d", f"SELECT *, sum(v) {W} AS total FROM panel", "w")(lambda s, d: P.panel_w(s, d).withColumn("total", F.sum("v").over(C.expanding(C.series()))))
query("w21_day_gaps", f"{K} gap:l", f"SELECT *, ts - lag(ts) {W} AS gap FROM daily", "d")(lambda s, d: P.bars_d(s, d).withColumn("gap", F.date_diff("ts", F.lag("ts").over(C.series()))))
E20 = "OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)"
query("w22_expanding_zscore", f"{K} z:d", f"SELECT *, CASE WHEN count(c) {E20} >= 20 THEN (c - avg(c) {E20}) / nullif(stddev_samp(c) {E20}, 0) END AS z FROM panel", "w")(lambda s, d: X.expanding_zscore(P.panel_w(s, d), "c"))
query("w23_rolling_and_expanding_mean", f"{K} rolling:d expanding:d", f"SELECT *, {roll('avg', 'c', 20)} AS rolling, avg(c) {E20} AS expanding FROM panel", "w")(
    lambda s, d: P.panel_w(s, d).withColumns({"rolling": C.rolling(F.avg, F.col("c"), 20, C.series()), "expanding": F.avg("c").over(C.expanding(C.series()))})
)


def _weekly(s, d):
    b = P.bars_d(s, d).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return b.groupBy("ticker", "week").agg(F.max_by("c", "ts").alias("last"), (C.ratio(F.max_by("c", "ts"), F.min_by("c", "ts")) - 1).alias("ret"), F.sum("v").alias("v"))


query(
    "w24_calendar_resample", "ticker week:t last:d ret:d v:d",
    "SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS week, arg_max(c, ts) AS last, arg_max(c, ts) / arg_min(c, ts) - 1 AS ret, sum(v) AS v FROM daily GROUP BY 1, 2", "d",
)(_weekly)
F20 = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
query("w25_rolling_correlation", f"{K} corr:d", f"SELECT *, CASE WHEN count(CASE WHEN c IS NOT NULL AND v IS NOT NULL THEN 1 END) {F20} = 20 THEN corr(c, v) {F20} END AS corr FROM panel", "w")(
    lambda s, d: P.panel_w(s, d).withColumn(
        "corr", F.when(F.count(F.when(F.col("c").isNotNull() & F.col("v").isNotNull(), 1)).over(C.series().rowsBetween(-19, 0)) == 20, F.corr("c", "v").over(C.series().rowsBetween(-19, 0)))
    )
)
query(
    "w26_islands", "ticker block:l state:s start:t end:t n:l",
    f"""SELECT ticker, block, max(state) AS state, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(f) {W} AS block FROM (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) {W} AND row_number() {W} > 1 THEN 0 ELSE 1 END AS f
    FROM (SELECT *, CASE WHEN c > o THEN 'up' WHEN c <= o THEN 'down' END AS state FROM panel))) GROUP BY 1, 2""", "w",
)(lambda s, d: X.islands(P.panel_w(s, d).withColumn("state", F.when(F.col("c") > F.col("o"), "up").when(F.col("c") <= F.col("o"), "down")), "state"))


def _chunks(s, d):
    from pyspark.sql import Window

    return P.bars_d(s, d).select("ts").distinct().withColumn("fold", F.ntile(5).over(Window.orderBy("ts")))


query("w27_equal_chunks", "ts:t fold:l", "SELECT ts, ntile(5) OVER (ORDER BY ts) AS fold FROM (SELECT DISTINCT ts FROM daily)", "d")(_chunks)
MOM = ", ".join(f"c / lag(c, {k}) {W} - 1 AS mom_{k}" for k in (5, 21, 63, 126)) + ", " + ", ".join(f"({roll('stddev_samp', 'r', k)}) * sqrt(252) AS rv_{k}" for k in (5, 21, 63))
query(
    "w28_rule_regime", f"{K} mom_5:d mom_21:d mom_63:d mom_126:d rv_5:d rv_21:d rv_63:d regime:s",
    f"SELECT *, CASE WHEN mom_63 IS NULL OR rv_63 IS NULL THEN NULL WHEN mom_63 > 0 AND rv_21 <= rv_63 THEN 'bull' WHEN mom_63 <= 0 AND rv_21 > rv_63 THEN 'crisis' ELSE 'neutral' END AS regime FROM (SELECT *, {MOM} FROM {PCT})", "w",
)(lambda s, d: X.rule_regime(P.panel_w(s, d)))


def features(s, d):
    """All 46 features of a ticker in one plan."""
    df = X.volume(X.average_true_range(X.realised_volatility(X.momentum(X.price_ranges(X.log_returns(P.panel_w(s, d)))))))
    df = df.withColumn("r", F.col("log_ret_1d"))

    cols = {f"ewma_vol_{k}d": ("r", lambda x, starts, k=k: V.ewm_std(x, k, starts) * X.YEAR) for k in H}
    return V.macd(V.by_series(df, cols)).drop("r")


FEATURES = [f"log_ret_{k}d" for k in (1, *H)] + [f"{n}_{k}d" for k in H for n in ("rolling_high", "rolling_low", "rolling_range", "breakout", "roc", "price_to_sma", "realized_vol", "ewma_vol")]
FEATURES += ["sma_cross_5_20", "atr_14d_norm", "macd", "macd_signal", "macd_hist", "vol_ma_20d", "rel_vol_20d", "vol_zscore_20d", "vol_momentum"]
PARTS = ["w03_log_returns", "w04_rolling_ranges", "w05_breakout", "w06_rate_of_change", "w07_price_to_sma", "w08_realised_volatility", "w09_ewma_volatility", "w10_average_true_range", "w11_macd", "w12_volume"]
PANEL = f"SELECT w03_log_returns.ticker, w03_log_returns.ts, {', '.join(FEATURES)} FROM " + " JOIN ".join(f"({BODIES[p]}) {p}" + (" USING (ticker, ts)" if k else "") for k, p in enumerate(PARTS))
query("feature_panel", f"{K} " + " ".join(f"{c}:d" for c in FEATURES), PANEL, "w")(features)
query("p18_forward_fill", f"{K} c:d", "SELECT ticker, ts, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM dpanel", "d")(
    lambda s, d: R.forward_filled(R.densify(P.bars_d(s, d)), "c")
)
query("p15_reindex", f"{K} pos:l c:d", "SELECT * FROM dpanel", "d")(lambda s, d: R.densify(P.bars_d(s, d)))
