import datetime as dt
import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import columns as C
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
from quantloom.plans import domain
from quantloom.sources import files, market, schema

NAN = float("nan")
BAR = "ticker string, ts date, o double, h double, l double, c double, v double"


def day(k: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def bars(spark, closes, ticker="A", days=None):
    closes = [None if c is None else float(c) for c in closes]
    return spark.createDataFrame([(ticker, (days or list(map(day, range(len(closes)))))[i], c, c, c, c, 1.0) for i, c in enumerate(closes)], BAR)


def test_asof_return_dates(spark):
    days = [day(k) for k in (0, 1, 2, 3, 4, 7, 8)]
    got = {r["ts"]: r["prev_ts"] for r in X.asof_returns(bars(spark, [1.0, 2, 3, 4, 5, 6, 7], days=days)).collect()}
    assert got == {day(2): day(0), day(3): day(1), day(4): day(2), day(7): day(4), day(8): day(4)}


def test_exponential_weights():
    assert np.allclose(V.ewm_std(np.array([1.0, 2, 4]), 3), [NAN, 0.70711, 1.58114], atol=1e-5, equal_nan=True)
    assert np.allclose(V.ewm_std(np.array([1.0, NAN, 4]), 3), [NAN, NAN, 2.12132], atol=1e-5, equal_nan=True)
    assert V.ema(np.array([1.0, 2, 4]), 3).tolist() == [1, 1.5, 2.75] and V.ema(np.array([1.0, NAN, 4]), 3).tolist() == [1, 1, 3]
    assert np.isnan(V.ema(np.array([NAN, NAN]), 3)).all() and len(V.ewm_std(np.array([]), 3)) == 0


@pytest.mark.parametrize(
    ("r", "vol", "want"),
    [
        ([NAN, 0.01, 0.015, -0.03, NAN, -0.015, 0.05, -0.01], [0.02] * 8, [(2, True), (3, False), (6, True)]),
        ([NAN, -0.019, 0.005, 0], [NAN, 0.02, 0.004, 0.004], [(2, True), (3, False)]),
        ([NAN, 0.02], [0.02, 0.02], []),
        ([], [], []),
    ],
)
def test_cusum(r, vol, want):
    assert [(i, u) for i, _, u in V.cusum(np.array(r), np.array(vol))] == want


def test_series_side_by_side_match_one_after_another():
    rng = np.random.default_rng(12)
    sizes = [int(n) for n in rng.integers(1, 60, 40)]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    x = rng.normal(size=sum(sizes)) * 0.02
    x[rng.random(len(x)) < 0.15] = NAN
    x[starts[3] : starts[4]] = NAN
    parts = np.split(x, starts[1:])
    assert np.allclose(V.ewm_std(x, 10, starts), np.concatenate([V.ewm_std(p, 10) for p in parts]), equal_nan=True, rtol=1e-12, atol=0)
    assert np.allclose(V.ema(x, 10, starts), np.concatenate([V.ema(p, 10) for p in parts]), equal_nan=True, rtol=1e-12, atol=0)
    vol = V.ewm_std(x, 10, starts)
    at, h, up = V.cusum_all(x, vol, starts)
    want = [(a + i, t, u) for a, p, v in zip(starts, parts, np.split(vol, starts[1:])) for i, t, u in V.cusum(p, v)]
    assert [(int(a), float(b), bool(c)) for a, b, c in zip(at, h, up)] == want and len(want) > 50


def test_series_that_span_batches(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(t, day(i), float(i % 5 + 1), math.sin(i * k)) for k, t in enumerate([None, "A", "B", "C"], 1) for i in range(k * 9)]
        df = spark.createDataFrame(rows, "ticker string, ts date, c double, ret double").coalesce(1)
        got = {(r["ticker"], r["ts"]): r["vol"] for r in V.by_series(df, {"vol": ("ret", lambda x, starts: V.ewm_std(x, 4, starts))}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k, t in enumerate([None, "A", "B", "C"], 1):
        want = V.ewm_std(np.array([math.sin(i * k) for i in range(k * 9)]), 4)
        assert all((got[t, day(i)] is None and np.isnan(v)) or abs(got[t, day(i)] - v) < 1e-12 for i, v in enumerate(want))


def barrier(spark, rows, policy="conservative", vol=0.02):
    data = [("A", day(i), c, h, low, c, 1.0, vol if i == 0 else None, i == 0) for i, (h, low, c) in enumerate(rows)]
    df = spark.createDataFrame(data, BAR + ", vol double, is_event boolean")
    return [(r["hit"], r["label"], r["exit_price"], (r["exit_ts"] - r["ts"]).days, r["holding"]) for r in L.triple_barrier(df, policy=policy).collect()]


def test_triple_barrier(spark):
    start = (100.0, 100.0, 100.0)
    assert barrier(spark, [start, (101.0, 99.0, 100.0), (102.0, 99.0, 101.0)]) == [("PT", 1, 102.0, 2, 2)]
    assert barrier(spark, [start, (101.0, 98.0, 99.0)]) == [("SL", -1, 98.0, 1, 1)]
    both = [start, (103.0, 97.0, 100.0), (101.0, 97.5, 98.0)]
    assert barrier(spark, both) == [("SL", -1, 98.0, 1, 1)] and barrier(spark, both, "optimistic") == [("PT", 1, 102.0, 1, 1)] and barrier(spark, both, "ignore") == [("SL", -1, 98.0, 2, 2)]
    assert barrier(spark, [start, *[(100.9, 99.5, 100.2)] * 4, (100.9, 99.5, 100.5), (200.0, 1.0, 1.0)]) == [("VERTICAL", 0, 100.5, 5, 5)]
    assert barrier(spark, [start, (None, 102.5, 102.5)]) == [("PT", 1, 102.0, 1, 1)]
    assert barrier(spark, [start]) == [("VERTICAL", 0, 100.0, 0, 0)]
    assert barrier(spark, [start, start], vol=None) == [] and barrier(spark, [start, start], vol=0.0) == []
    assert barrier(spark, [start, (None, None, None)]) == []


def test_concurrency_and_uniqueness(spark):
    cal = R.calendar(spark.createDataFrame([(day(k),) for k in range(6)], "ts date"))
    lab = spark.createDataFrame([("A", day(0), day(2)), ("B", day(1), day(3)), ("C", day(5), day(5))], "ticker string, ts date, exit_ts date")
    assert [r["n"] for r in L.concurrency(lab, cal).orderBy("ts").collect()] == [1, 2, 2, 1, 0, 1]
    assert [round(r["uniqueness"], 9) for r in L.uniqueness(lab, cal).orderBy("ts").collect()] == [round(2 / 3, 9), round(2 / 3, 9), 1.0]


def test_purged_folds(spark):
    lab = spark.createDataFrame([(i, day(i), day(min(9, i + 1))) for i in range(10)], "label_index long, ts date, exit_ts date")
    got = {}
    for r in CV.purged_folds(lab, 5, 0.1).collect():
        got.setdefault((r["fold"], r["split"]), []).append(r["label_index"])
    pick = lambda f, s: sorted(got[f, s])
    assert pick(1, "Test") == [0, 1] and pick(1, "Train") == [3, 4, 5, 6, 7, 8, 9]
    assert pick(2, "Test") == [2, 3] and pick(2, "Train") == [0, 5, 6, 7, 8, 9]
    assert pick(5, "Test") == [8, 9] and pick(5, "Train") == [0, 1, 2, 3, 4, 5, 6]
    assert CV.expanding_splits(600, 5, 252, 63)[0] == (1, 285, 285, 348)
    with pytest.raises(ValueError):
        CV.expanding_splits(300)


def test_bootstrap_size(spark):
    spans = spark.createDataFrame([(i, i % 20, i % 20 + 3) for i in range(150)], "label_index long, a long, b long")
    draw = lambda **k: {r["label_index"]: r["n_draws"] for r in L.sequential_bootstrap(spans, 150, 30, **k).collect()}
    assert sum(draw().values()) == 150 and sum(draw(remainder=False).values()) == 100 and draw() == draw()
    assert L.sequential_bootstrap(spans.limit(0), 10, 30).count() == 0


def test_fracdiff_weights_and_values(spark):
    assert D.ffd_weights(0.5)[:4] == [1, -0.5, -0.125, -0.0625] and D.ffd_weights(1.0) == [1, -1]
    assert {d: len(D.ffd_weights(d)) for d in (0.1, 0.5, 0.9)} == {0.1: 503, 0.5: 200, 0.9: 38}
    got = [r["fracdiff"] for r in D.ffd(bars(spark, [1.0, None, 4.0, 9.0]), 1.0).orderBy("ts").collect()]
    assert got == [None, 3.0, 5.0]


def test_stationarity():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=400)
    assert D.is_stationary(noise)[0] and not D.is_stationary(noise.cumsum())[0]
    assert D.is_stationary(noise[:20]) == (False, 1.0, 0.0) and D.is_stationary(np.ones(100)) == (False, 1.0, 0.0)
    assert D.best_order(noise)[0] == 0.0 and 0 < D.best_order(rng.normal(size=1500).cumsum())[0] <= 1


def test_costs(spark):
    w = lambda d: spark.createDataFrame([(day(0), k, v) for k, v in d.items()], "ts date, ticker string, w double")
    r = Q.transaction_costs(w({"A": 0.5, "B": 0.5}), w({"B": 0.25, "C": 0.5}), 1e6).first()
    assert [r[k] for k in ("turnover", "commission", "slippage", "spread", "total")] == [1.25, 125, 625, 125, 875]


def test_calibration_and_lift(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.3), (1, 0.4), (0, 0.6)], "y int, p double").withColumn("pred", (F.col("p") > 0.5).cast("int"))
    c, g = E.calibration(df).first(), E.profit_lift(df).first()
    assert (round(c["brier"], 4), round(c["log_loss"], 5), c["auc"]) == (0.2125, 0.6030, 0.75) or abs(c["log_loss"] - 0.60310) < 1e-4
    assert (g["base"], g["filtered"], g["lift"], g["retention"]) == (0.5, 0.5, 0.0, 0.5)
    b = E.binary(df).first()
    assert tuple(b) == (0.5, 0.5, 0.5, 0.5)


def test_merge_of_repeated_bars(spark):
    df = spark.createDataFrame([("A", day(0), 10.0, 12.0, 9.0, 11.0, 5.0, 1), ("A", day(0), 11.0, 13.0, 10.0, 12.0, 7.0, 2), ("A", day(0), 11.0, 13.0, 10.0, 12.0, 7.0, 2)], BAR + ", k int")
    r = A.merge_bars(df, F.col("k")).first()
    assert (r["o"], r["h"], r["l"], r["c"], r["v"]) == (10, 13, 9, 12, 12)


def test_rolling_needs_all_values(spark):
    last = lambda xs: bars(spark, xs).withColumn("m", C.rolling(F.avg, F.col("c"), 5, C.series())).orderBy(F.desc("ts")).first()["m"]
    assert last([1.0, 2, 3, 4]) is None and last([1.0, None, 3, 4, 5]) is None and last([1.0, 2, 3, 4, 5]) == 3


def test_missing_cause(spark):
    df = bars(spark, [None, None, 1.0, 2.0])
    r = A.missing_profile(df).first()
    assert (r["total"], r["structural"], r["cause"]) == (2, 2, "Unexpected Missing")
    assert A.missing_profile(bars(spark, [1.0, None, 2.0, 1.0])).first()["cause"] == "Holiday or Halt"
    assert A.missing_profile(bars(spark, [None, None])).first()["cause"] == "Structural Empty"


def test_schema_detection_and_normalising(spark):
    make = lambda *c: spark.createDataFrame([], ", ".join(f"`{x}` {'string' if x in ('Date', 'Ticker') else 'double'}" for x in c))
    assert schema.detect(make("Date", "Ticker", "Open", "High", "Low", "Close")) == schema.Kind.LONG
    assert schema.detect(make("Date", "Open", "High", "Low", "Close")) == schema.Kind.OHLCV
    assert schema.detect(make("Date", "x")) == schema.Kind.SINGLE and schema.detect(make("Date", "x", "y")) == schema.Kind.MULTI
    raw = spark.createDataFrame([("2024-01-02 03:00:00", "A", "1.5", "bad", "1", NAN, "7", "1")], "`date` string, symbol string, OPEN string, high string, low string, close double, volume string, `Adj Close` string")
    r = schema.normalise(raw).first()
    assert (r["ts"], r["o"], r["h"], r["c"], r["v"]) == (day(0), 1.5, None, None, 7)
    assert schema.hard_faults(raw) == ["too few rows"] and schema.hard_faults(raw.union(raw)) == ["duplicate keys"]


def test_edges_of_windowed_operators(spark):
    for f in (X.log_returns, X.price_ranges, X.momentum, X.realised_volatility, X.average_true_range, X.volume, X.drawdown, X.rule_regime, V.macd):
        assert f(bars(spark, [])).count() == 0 and f(bars(spark, [5.0])).count() == 1
        assert f(bars(spark, [None, None])).count() == 2 and f(bars(spark, [0.0, -1.0, 3.0]).union(bars(spark, [2.0], "B", [day(9)]))).count() == 4
    r = X.log_returns(bars(spark, [0.0, -1.0, 3.0])).orderBy("ts").collect()
    assert [x["log_ret_1d"] for x in r] == [None, None, None]
    with pytest.raises(ValueError):
        X.cross_asset(bars(spark, [1.0]), ["none"])


def test_joins(spark):
    left = spark.createDataFrame([(day(0), 1), (day(3), 2), (day(5), 3)], "ts date, k int")
    right = spark.createDataFrame([(day(1), 7), (day(5), 8)], "ts date, s int")
    assert [r["s"] for r in J.asof(left, right, "s", default=1).orderBy("k").collect()] == [1, 7, 8]
    cal = R.calendar(right.select("ts"))
    assert [r["pos"] for r in J.positions(left, cal).orderBy("k").collect()] == [-1, -1, 2]
    with pytest.raises(Exception, match="calendar"):
        J.positions(left, cal, strict=True).collect()


def test_hidden_states_are_found(spark):
    rng = np.random.default_rng(4)
    state = np.repeat([0, 2, 1, 0, 2], 150)
    x = rng.normal(size=(750, 2)) * np.array([0.3, 1.0, 4.0])[state][:, None]
    start, move, mean, cov, seen = G.fit_hmm(x, 3, 60)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and np.allclose(move.sum(1), 1)
    assert [np.trace(c) for c in cov] == sorted(np.trace(c) for c in cov)
    p, _ = G.forward(G._density(x, mean, cov), start, move)
    assert (p.argmax(1) == state).mean() > 0.85
    df = spark.createDataFrame([(day(i), float(a), float(b)) for i, (a, b) in enumerate(x[:200])], "ts date, a double, b double")
    got = G.expanding_regimes(df, ["a", "b"], least=120, every=40, rounds=5)
    assert got.count() == 80 and got.where("abs(regime_0_prob + regime_1_prob + regime_2_prob - 1) > 1e-9").count() == 0


def test_optimiser_meets_its_conditions():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 6)) * 0.01
    cov, mu = Q.covariance(a), rng.normal(size=6) * 0.02
    for k in ("max_sharpe", "min_variance", "risk_parity", "return"):
        w = Q.optimise(mu, cov, np.full(6, 1 / 6), Q.Limits(cap=0.4, objective=k))
        assert (w >= 0).all() and (w <= 0.4 + 1e-6).all() and w.sum() <= 1 + 1e-6
        goal = {"max_sharpe": lambda x: 2 * x @ cov @ x - mu @ x, "min_variance": lambda x: x @ cov @ x, "risk_parity": lambda x: x @ cov @ x, "return": lambda x: -mu @ x}[k]
        full = lambda x: goal(x) + 0.005 * np.abs(x - 1 / 6).sum()  # noqa: B023, E731
        low = 0.2 / 6 if k == "risk_parity" else 0.0
        for _ in range(300):
            y = np.clip(w + rng.normal(size=6) * 0.05, low, 0.4)
            y = y if y.sum() <= 1 else np.clip(y - (y.sum() - 1) / 6, low, 0.4)
            assert y.sum() > 1 + 1e-9 or full(w) <= full(y) + 1e-5
    short = Q.optimise(mu, cov, np.zeros(6), Q.Limits(leverage=1.5, cap=0.4, objective="return"), cost=0.0)
    assert np.abs(short).sum() <= 1.5 + 1e-4


def test_shrinkage():
    x = np.random.default_rng(1).normal(size=(200, 5))
    for m in ("sample", "oas", "ledoit_wolf"):
        assert np.allclose(np.diag(Q.covariance(x, m)), x.var(0), atol=0.5) and (np.linalg.eigvalsh(Q.covariance(x, m)) > 0).all()
    few = Q.covariance(x[:50])
    assert np.allclose(few, np.eye(5) * x[:50].var(0, ddof=1).mean())
    assert np.allclose(Q.covariance(np.full((3, 2), np.nan)), 1e-4 * np.eye(2)) and np.allclose(Q.covariance(x, "sample"), np.cov(x.T, bias=True) + 1e-6 * np.eye(5))
    holes = np.c_[x, np.full(200, np.nan)]
    assert np.allclose(Q.covariance(holes)[:5, :5], Q.covariance(x)) and Q.covariance(holes)[5, 5] == 1e-6
    with pytest.raises(ValueError):
        Q.covariance(x, "other")


def test_classification_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (2, 1)], "label int, pred int")
    s = E.classification(df)
    assert s["accuracy"] == 0.6 and abs(s["balanced_accuracy"] - 0.5) < 1e-12
    assert {r["class"]: r["support"] for r in E.per_class(df).collect()} == {0: 2, 1: 2, 2: 1}


def test_features_exclude_what_a_model_must_not_see(spark):
    df = spark.createDataFrame([], "ticker string, ts date, exit_price double, ret double, holding int, uniqueness double, label int, roc_5d double, fold int")
    assert ML.feature_names(df) == ["roc_5d"]


def test_files_round_trip(spark, tmp_path):
    df = bars(spark, [1.0, 2.0])
    files.write_parquet(df, f"{tmp_path}/tree/x", None)
    assert files.read_tree(spark, f"{tmp_path}/tree").count() == 2
    files.write_csv(df, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/none", f"{tmp_path}/csv").columns == df.columns
    files.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    files.write_report(A.violations(bars(spark, [-1.0, 2.0])), f"{tmp_path}/txt")
    assert "[price] 1" in "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/txt").collect())
    got = files.constituents(spark.createDataFrame([(" BRK.B ", "x"), ("", "y"), ("nan", "z")], "symbol string, `gics sector` string")).collect()
    assert [tuple(r) for r in got] == [("BRK-B", "x", None)]


def test_landed_market_source(spark, tmp_path):
    (tmp_path / "B.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,\n")
    market.register(spark)
    got = spark.read.format("landed_market").option("path", str(tmp_path)).option("symbols", "A|B,C").load().collect()
    assert [tuple(r) for r in got] == [("A", "2024-01-01", 1.0, 2.0, 0.5, 1.5, None)]


def test_retries():
    calls = []

    def fail():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        files.with_retries(fail, 3, 0)
    assert len(calls) == 3


def test_rebalance_dates(spark):
    cal = spark.createDataFrame([(dt.date(2024, 1, 30),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 28),)], "ts date")
    assert [r["ts"].day for r in Q.rebalance_dates(cal).orderBy("ts").collect()] == [30, 29, 28]
    assert [r["ts"].day for r in Q.rebalance_dates(cal, exact=True).collect()] == [29]
    assert Q.rebalance_dates(cal, "quarter").count() == 1 and Q.rebalance_dates(cal, "week").count() == 3


def test_reshaping(spark):
    df = spark.createDataFrame([(day(0), 1.0, None, 3.0)], "ts date, `Close|A` double, `Close|B` double, `High|A` double")
    assert [tuple(r) for r in R.cross_section(df, "close").collect()] == [(day(0), "A", 1.0)]
    assert R.drop_empty_columns(df).columns == ["ts", "Close|A", "High|A"]
    with pytest.raises(ValueError):
        R.drop_empty_columns(spark.createDataFrame([(None,)], "a int"))
    assert R.collapse_by_tickers(bars(spark, [None]).union(bars(spark, [1.0], "B")), "ticker", "c").count() == 1
    assert math.isclose(bars(spark, [1.0]).select(C.basis_points(F.lit(7.0)).alias("x")).first()["x"], 0.0007)


def test_stream_equals_batch(spark, tmp_path):
    from quantloom.streaming.cusum import cusum_stream

    rng = np.random.default_rng(2)
    rows = [(t, day(i), 1.0, None if i == 7 else float(rng.normal())) for t in "AB" for i in range(80)]
    df = spark.createDataFrame(rows, "ticker string, ts date, c double, ret double")
    for k in range(4):
        lo, hi = day(20 * k), day(20 * k + 20)
        df.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = cusum_stream(stream).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r["ticker"], r["ts"], r["direction"], round(r["threshold"], 9)) for r in d.collect())
    assert key(spark.table("events_out")) == key(V.cusum_events(df)) != []


def test_registered_models_predict_every_label(spark, monkeypatch):
    rows = [(k, day(k // 2), day(k // 2 + 1), k % 3, 1.0, float(k % 7)) for k in range(120)]
    m = spark.createDataFrame(rows, "label_index long, ts date, exit_ts date, y int, w double, f double")
    seen, real = [], ML.classifier

    def small(name, trees=None, **k):
        seen.append((name, trees))
        return real("logistic") if name != "meta_forest" else real(name, trees=2)

    monkeypatch.setattr(domain, "master", lambda s, d: m)
    monkeypatch.setattr(domain, "MODEL", ["f"])
    monkeypatch.setattr(domain, "once", lambda key, spark, build: build())
    monkeypatch.setattr(ML, "classifier", small)
    for got in (domain.fitted(spark, "", "forest"), domain.predictions(spark, ""), domain.meta(spark, "")):
        out = got.select("label_index", "fold").collect()
        assert sorted(r["label_index"] for r in out) == list(range(120)) and {r["fold"] for r in out} == {1, 2, 3, 4, 5}
    assert {k for _, k in seen} == {None}
    monkeypatch.undo()
    assert ML.classifier("forest").getNumTrees() == ML.classifier("meta_forest").getNumTrees() == 100
    assert ML.classifier("boosted").getClassifier().getMaxIter() == 100


def test_registered_regimes_refit_as_the_reference_does(monkeypatch):
    real, seen = inspect.signature(G.expanding_regimes), []

    def record(*a, **k):
        b = real.bind(*a, **k)
        b.apply_defaults()
        seen.append([b.arguments[x] for x in ("states", "least", "every", "rounds")])

    monkeypatch.setattr(domain, "once", lambda key, spark, build: build())
    monkeypatch.setattr(domain, "macro_returns", lambda s, d: None)
    monkeypatch.setattr(G, "expanding_regimes", record)
    domain.regimes(None, "")
    assert seen == [[3, 504, 60, 100]]


def test_registered_bootstrap_draws_as_often_as_the_reference(spark, monkeypatch):
    spans = spark.range(6000).selectExpr("id AS label_index", "id % 290 AS a", "id % 290 + 1 + id % 5 AS b")
    monkeypatch.setattr(domain, "spans", lambda s, d: (spans, 300))
    got = domain.bootstrap(spark, "").agg(F.sum("n_draws").alias("draws"), F.count("*").alias("labels")).first()
    assert got["draws"] == 500_000 and got["labels"] == 6000


def test_covariances_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 10)) * 0.02 + 0.5
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    rows = [(f"t{j}", day(i), None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(40) for j in range(10)]
    df = spark.createDataFrame(rows, "ticker string, ts date, ret double")
    import pandas as pd

    want = pd.DataFrame(x).cov()
    got = {(r["a"], r["b"]): r["cov"] for r in Q.sample_covariance(df).collect()}
    assert len(got) == 45 and all(abs(got[f"t{i}", f"t{j}"] - want[i][j]) < 1e-12 for i in range(9) for j in range(i, 9))
    full = {k: Q.covariance(x, k, least=10) for k in ("sample", "ledoit_wolf", "oas")}
    shrunk = Q.shrunk_covariance(df).collect()
    assert len(shrunk) == 55
    for r in shrunk:
        i, j = int(r["a"][1:]), int(r["b"][1:])
        assert all(abs(r[k] - full[k][i, j]) < 1e-12 for k in full)


def test_percentiles_are_exact_however_narrow_the_bracket(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=5000), np.r_[np.full(3000, 7.0), rng.integers(0, 40, 2000)]
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    for most in (100_000, 60):
        got = A.exact_percentiles(df, ["a", "b", "c"], [0.0, 0.05, 0.5, 0.95, 1.0], most)
        for p in (0.0, 0.05, 0.5, 0.95, 1.0):
            assert abs(got["a", p] - np.quantile(a, p)) < 1e-12 and abs(got["b", p] - np.quantile(b, p)) < 1e-12 and got["c", p] is None


def test_auc_over_ranges_of_scores(spark):
    rng = np.random.default_rng(7)
    y, p = rng.integers(0, 2, 900), np.round(rng.random(900), 2)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    for ranges in (1, 7, 256):
        assert abs(E.calibration(df, ranges=ranges).first()["auc"] - np.mean(pairs)) < 1e-12
    assert E.calibration(df.where("y = 1")).first()["auc"] is None


def test_backtest_by_hand():
    import pandas as pd

    days = [day(i) for i in range(6)]
    ret = {"A": [0.01, 0.02, 0.1, -0.05, 0.0, 0.2], "B": [0.0, 0.01, 0.0, 0.05, 0.02, 0.1]}
    mu = {t: [None, 0.5, None, 0.5, 0.5, None] for t in ret}  # days 1 to 4 can trade
    pdf = pd.DataFrame([(d, t, ret[t][i], mu[t][i], 1) for i, d in enumerate(days) for t in ret], columns=["ts", "ticker", "ret", "mu", "regime"])
    equity, turns, held = Q.Backtest(limits={1: Q.Limits(cap=0.6)}, capital=100.0).run_frame(pdf, {days[1], days[5]})
    assert list(equity["ts"]) == days[1:5] and len(turns) == 1
    w = {r.ticker: r.w for r in held.itertuples() if r.ts == days[1]}
    cost = sum(abs(x) for x in w.values()) * 100 * 7 / 10_000
    net, gross = 100 - cost, 100.0
    assert abs(equity["net"].iloc[0] - net) < 1e-9 and abs(turns["cost"].iloc[0] - cost) < 1e-12
    for i in (2, 3, 4):
        r = sum(w[t] * ret[t][i] for t in w)
        net, gross = net * (1 + r), gross * (1 + r)
        w = {t: w[t] * (1 + ret[t][i]) for t in w}
        w = {t: x / sum(w.values()) for t, x in w.items()}
        assert abs(equity["net"].iloc[i - 1] - net) < 1e-9 and abs(equity["gross"].iloc[i - 1] - gross) < 1e-9
    nothing = Q.Backtest().run_frame(pdf.assign(mu=None), {days[1]})
    assert all(len(x) == 0 for x in nothing)


def test_weights_stay_where_the_solver_finds_none():
    now = np.array([0.3, 0.1])
    assert (Q.optimise(np.array([0.1, 0.2]), np.eye(2), now, Q.Limits(cap=0.4), rounds=1) == now).all()
    assert (Q.optimise(np.array([0.1, 0.2]), np.eye(2), 0 * now, Q.Limits(cap=0.4), rounds=1) == 0.5).all()


def test_a_broken_first_file_is_an_error(spark, tmp_path):
    (tmp_path / "good.csv").write_text("A,b\n1,2\n")
    assert files.read_csv(spark, f"{tmp_path}/none.csv", f"{tmp_path}/good.csv").columns == ["a", "b"]
    (tmp_path / "dir.csv").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, f"{tmp_path}/dir.csv", f"{tmp_path}/good.csv").count()


def test_batched_files_become_one_long_table(spark, tmp_path):
    b = bars(spark, [1.0, None, 3.0]).unionByName(bars(spark, [None, None, None], "B")).unionByName(bars(spark, [2.0], "C"))
    paths = files.write_batches(b, str(tmp_path), size=2)
    got = files.read_batched(spark, paths).select("ticker", "ts", "close").collect()
    assert len(paths) == 2 and {("A", day(0), 1.0), ("A", day(2), 3.0), ("C", day(0), 2.0)} <= {tuple(r) for r in got}


def test_registry_of_sources():
    from quantloom.sources.registry import series

    assert len(series()) == 125 and len({(c, n) for c, n, _ in series()}) == 125 and all(s for _, _, s in series())


def test_tables_are_written_once_and_again_when_they_are_gone(spark):
    import shutil

    from quantloom.functions import stage

    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for n in (1, 1):
        assert stage.once(("t", 1), spark, build).count() == 3 and len(made) == n
    shutil.rmtree(stage._WRITTEN[spark.sparkContext.applicationId, "t", 1].removeprefix("file://"))
    assert stage.once(("t", 1), spark, build).count() == 3 and len(made) == 2


def test_hidden_states_match_plain_recursions():
    rng = np.random.default_rng(3)
    logb, move, start = rng.normal(size=(30, 3)) * 3, rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    a, scale = G.forward(logb, start, move)
    p, total = start * np.exp(logb[0]), 0.0
    for t in range(30):
        p = (p @ move) * np.exp(logb[t]) if t else p
        assert np.allclose(a[t], p / p.sum())
    assert abs(scale.sum() - np.log(p.sum())) < 1e-9
    b, beta = np.exp(logb), np.ones(3)
    got = G.backward(b, move)
    for t in range(28, -1, -1):
        beta = move @ (b[t + 1] * beta)
        assert np.allclose(got[t], beta / beta.sum())
