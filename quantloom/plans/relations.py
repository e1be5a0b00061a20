"""Queries of scans, projections, joins, aggregates, sets and scalars (S, P, J, A, O, U, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.stage import folder
from quantloom.operators import aggregates as A
from quantloom.operators import joins as J
from quantloom.operators import reshape as R
from quantloom.sources import files, registry, schema

from . import panels as P
from .registry import query

K = "ticker ts:t"
W = "OVER (PARTITION BY ticker ORDER BY ts)"
T = P.table

# Scans.
query("s01_parquet_scan", "l_orderkey:l l_extendedprice:d", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45")(
    lambda s, d: T(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_extendedprice")
)


def _tree(s, d):
    df = s.read.option("recursiveFileLookup", True).option("pathGlobFilter", "region*").parquet(d)
    return df.withColumn("dataset", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


query("s02_recursive_scan", "dataset n:l", "SELECT 'region' AS dataset, count(*) AS n FROM region")(_tree)
query("s03_scan_with_key_filter", "n:l total:d", "SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")(
    lambda s, d: T(s, d, "lineitem").join(T(s, d, "part").where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
)


def _constituents(s, d):
    t = T(s, d, "customer").select(F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "."), F.lit(" ")).alias("symbol"), F.col("c_mktsegment").alias("gics sector"), F.lit(None).cast("string").alias("gics sub-industry"))
    return files.constituents(t)


query("s08_constituents", "symbol sector industry", "SELECT replace(c_name, '#', '-') AS symbol, c_mktsegment AS sector, CAST(NULL AS VARCHAR) AS industry FROM customer")(_constituents)


def _csv(s, d):
    df = T(s, d, "nation").select(F.col("n_nationkey").alias("N_NationKey"), F.col("n_name").alias(" N_Name"))
    path = folder(df)
    files.write_csv(df, f"{path}/csv")
    return files.read_csv(s, f"{path}/none", f"{path}/csv")


query("s04_csv_scan", "n_nationkey:l n_name", "SELECT n_nationkey, n_name FROM nation")(_csv)
query("s13_csv_sink", "n_nationkey:l n_name", "SELECT n_nationkey, n_name FROM nation")(_csv)


def _batched(s, d):
    """Bars through wide files of ten tickers, with a ticker that never has a value, and back."""
    b = P.bars_w(s, d)
    none = b.groupBy("ts").agg(*[F.lit(None).cast("double").alias(c) for c in "ohlcv"]).withColumn("ticker", F.lit("none"))
    return files.read_batched(s, files.write_batches(b.unionByName(none), folder(b), size=10))


BATCHED = f"{K} open:d high:d low:d close:d volume:d"
# Roots of the prices, so that none lies halfway between two rounded values.
query("s06_batched_source", BATCHED, "SELECT ticker, ts, sqrt(o) AS open, sqrt(h) AS high, sqrt(l) AS low, sqrt(c) AS close, v AS volume FROM bars", "w")(
    lambda s, d: _batched(s, d).withColumns({c: F.sqrt(c) for c in ("open", "high", "low", "close")})
)
query("s11_wide_source", "ticker n:l first:t last:t", "SELECT ticker, count(*) AS n, min(ts) AS first, max(ts) AS last FROM bars GROUP BY 1", "w")(
    lambda s, d: _batched(s, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
)
query("s10_source_registry", "category n:l symbols:l", "SELECT unnest(['indices', 'sectors', 'volatility', 'forex', 'commodities', 'yields', 'macro', 'world']) AS category, unnest([12, 22, 7, 8, 15, 11, 34, 16]) AS n, unnest([16, 22, 8, 9, 16, 11, 34, 17]) AS symbols")(
    lambda s, d: registry.registry(s).groupBy("category").agg(F.count_if(F.col("place") == 0).alias("n"), F.count(F.lit(1)).alias("symbols"))
)


def _parquet(s, d):
    b = P.bars_w(s, d)
    path = folder(b)
    files.write_parquet(b, f"{path}/tree/bars", ["ticker"])
    return s.read.parquet(f"{path}/tree/bars").withColumn("snappy", F.col("_metadata.file_name").contains(".snappy."))


query("s12_parquet_sink", f"{K} c:d v:d snappy:b", "SELECT ticker, ts, c, v, true AS snappy FROM bars", "w")(_parquet)


def _metadata(s, d):
    g = P.bars_w(s, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    path = folder(g)
    files.write_json(g, path)
    return s.read.schema("rows long, tickers long, first date, last date").json(path)


query("s14_metadata", "rows:l tickers:l first:t last:t", 'SELECT count(*) AS "rows", count(DISTINCT ticker) AS tickers, min(ts) AS first, max(ts) AS last FROM bars', "w")(_metadata)

# Projections and filters.
query("p01_projection", f"{K} c:d", "SELECT ticker, ts, c FROM bars", "w")(lambda s, d: P.bars_w(s, d).select("ticker", "ts", "c"))


def _raw(s, d):
    return P.bars_d(s, d).select(F.col("ts").alias("DATE"), F.col("ticker").alias("ticker"), *[F.col(a).alias(b) for a, b in zip("ohlc", ("OPEN", "high", "Low", "CLOSE"), strict=True)], F.col("c").alias("Adj Close"), F.col("v").alias("VOLUME"))


query("p02_canonical_names", "Ticker Date:t Open:d High:d Low:d Close:d Volume:d", 'SELECT ticker AS "Ticker", ts AS "Date", o AS "Open", h AS "High", l AS "Low", c AS "Close", v AS "Volume" FROM daily', "d")(
    lambda s, d: R.rename_canonical(_raw(s, d))
)
query("p03_drop_adjusted", "ticker DATE:t CLOSE:d", 'SELECT ticker, ts AS "DATE", c AS "CLOSE" FROM daily', "d")(lambda s, d: R.drop_adjusted(_raw(s, d)))
query("p04_drop_empty_columns", f"{K} c:d", "SELECT ticker, ts, c FROM bars", "w")(lambda s, d: R.drop_empty_columns(P.bars_w(s, d).select("ticker", "ts", "c", F.lit(None).cast("double").alias("none"))))
query("p05_drop_null_keys", "n:l", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0")(
    lambda s, d: T(s, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))).na.drop(subset=["k"]).agg(F.count(F.lit(1)).alias("n"))
)
query("p06_drop_nulls_in", f"{K} c:d", "SELECT ticker, ts, c FROM dpanel WHERE c IS NOT NULL AND v IS NOT NULL", "d")(lambda s, d: R.densify(P.bars_d(s, d)).na.drop(subset=["c", "v"]))
query("p07_drop_all_null_rows", f"{K} pos:l", "SELECT * FROM dpanel WHERE coalesce(o, h, l, c, v) IS NOT NULL", "d")(lambda s, d: R.densify(P.bars_d(s, d)).na.drop(how="all", subset=["o", "h", "l", "c", "v"]))
query("p08_mask_filter", f"{K} c:d", "SELECT * FROM bars WHERE c > o AND NOT (v < 50)", "w")(lambda s, d: P.bars_w(s, d).where((F.col("c") > F.col("o")) & ~(F.col("v") < 50)))
query("p09_membership", "n:l", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")(
    lambda s, d: T(s, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).join(T(s, d, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))
)
query("p10_numeric_columns", "name", "SELECT unnest(['l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name")(
    lambda s, d: s.createDataFrame([(c,) for c in R.numeric_columns(T(s, d, "lineitem"), ("l_orderkey", "l_partkey"))], "name string")
)
query("p11_macro_columns", "ts:t x_Close:d", 'SELECT ts, c AS "x_Close" FROM daily WHERE ticker = \'BUILDING\'', "d")(
    lambda s, d: R.macro_columns(P.bars_d(s, d).where("ticker = 'BUILDING'").select("ts", F.col("o").alias("Open"), F.col("h").alias("High"), F.col("l").alias("Low"), F.col("c").alias("Close")), "x", "OHLCV")
)
M = ["m1", "m2", "m3", "m4", "m5"]
query("p13_pivot", "ts:t " + " ".join(f"{m}:d" for m in M), "SELECT ts, " + ", ".join(f"max(value) FILTER (feature = '{m}') AS {m}" for m in M) + " FROM macro GROUP BY ts", "m")(
    lambda s, d: R.pivot(P.macro(s, d), "ts", "feature", "value", M)
)
query("p12_melt", "ts:t ticker value:d", "SELECT ts, feature AS ticker, value FROM macro WHERE value IS NOT NULL", "m")(lambda s, d: R.melt(R.pivot(P.macro(s, d), "ts", "feature", "value", M), ["ts"]))


def _wide(s, d):
    b = P.bars_d(s, d)
    seg = ["AUTOMOBILE", "BUILDING"]
    return b.groupBy("ts").agg(*[F.max(F.when(F.col("ticker") == x, F.col(f))).alias(f"{n}|{x}") for x in seg for f, n in (("c", "Close"), ("h", "High"))])


query("p14_cross_section", "ts:t ticker value:d", "SELECT ts, ticker, c AS value FROM daily WHERE ticker IN ('AUTOMOBILE', 'BUILDING')", "d")(lambda s, d: R.cross_section(_wide(s, d), "close"))
query("p16_reindex_with_fill", f"{K} c:d", "SELECT p.ticker, p.ts, b.c FROM dpanel p ASOF LEFT JOIN daily b ON b.ticker = p.ticker AND p.ts >= b.ts", "d")(
    lambda s, d: J.asof(R.densify(P.bars_d(s, d)).select("ticker", "ts"), P.bars_d(s, d).select("ticker", "ts", "c"), "c", by=["ticker"])
)
query("p17_constant_fill", f"{K} v:d", "SELECT ticker, ts, coalesce(v, 0) AS v FROM dpanel", "d")(lambda s, d: R.densify(P.bars_d(s, d)).withColumn("v", F.coalesce("v", F.lit(0.0))))
query("p19_case_mapping", "code:l hit label:l n:l", "SELECT l_linenumber % 4 AS code, CASE l_linenumber % 4 WHEN 1 THEN 'PT' WHEN 2 THEN 'SL' WHEN 3 THEN 'VERTICAL' END AS hit, CASE l_linenumber % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 0 END AS label, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")(
    lambda s, d: T(s, d, "lineitem").withColumn("code", F.col("l_linenumber") % 4).withColumn("hit", R.hit_name(F.col("code"))).withColumn("label", R.hit_label(F.col("code"))).groupBy("code", "hit", "label").agg(F.count(F.lit(1)).alias("n"))
)
query("p20_class_index", "label:l multi:l two:l n:l", "SELECT l_linenumber % 3 - 1 AS label, l_linenumber % 3 AS multi, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 END AS two, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")(
    lambda s, d: T(s, d, "lineitem").withColumn("label", F.col("l_linenumber") % 3 - 1).withColumn("multi", R.class_index(F.col("label"))).withColumn("two", R.class_index(F.col("label"), False)).groupBy("label", "multi", "two").agg(F.count(F.lit(1)).alias("n"))
)
query("p21_first_argmax", f"{K} best:l", "SELECT ticker, ts, list_position([o, c, h], greatest(o, c, h)) - 1 AS best FROM bars", "w")(lambda s, d: P.bars_w(s, d).withColumn("best", C.first_argmax([F.col("o"), F.col("c"), F.col("h")])))
query("p22_threshold", "pred:l n:l", "SELECT CAST(l_discount * 10 > 0.5 AS INTEGER) AS pred, count(*) AS n FROM lineitem GROUP BY 1")(
    lambda s, d: T(s, d, "lineitem").withColumn("pred", (F.col("l_discount") * 10 > 0.5).cast("int")).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
)

# Joins.
query("j01_inner_two_keys", f"{K} c:d m:d", "SELECT b.ticker, b.ts, b.c, d.c AS m FROM daily b JOIN (SELECT ticker, ts, c FROM daily WHERE v >= 2) d ON b.ticker = d.ticker AND b.ts = d.ts", "d")(
    lambda s, d: P.bars_d(s, d).select("ticker", "ts", "c").join(P.bars_d(s, d).where("v >= 2").select("ticker", "ts", F.col("c").alias("m")), ["ticker", "ts"])
)
query("j02_left_by_date", f"{K} c:d value:d", "SELECT d.ticker, d.ts, d.c, m.value FROM daily d LEFT JOIN macro m ON m.ts = d.ts AND m.feature = 'm1'", "md")(
    lambda s, d: P.bars_d(s, d).join(P.macro(s, d).where("feature = 'm1'").select("ts", "value"), "ts", "left")
)
query("j03_left_two_keys", f"{K} c:d w:d", "SELECT p.ticker, p.ts, p.c, b.v AS w FROM dpanel p LEFT JOIN daily b ON p.ticker = b.ticker AND p.ts = b.ts AND b.v > 1", "d")(
    lambda s, d: R.densify(P.bars_d(s, d)).join(P.bars_d(s, d).where("v > 1").select("ticker", "ts", F.col("v").alias("w")), ["ticker", "ts"], "left")
)
query("j04_panel_joins", f"{K} c:d a:d b:d", "SELECT p.ticker, p.ts, p.c, x.o AS a, y.h AS b FROM panel p LEFT JOIN bars x ON x.ticker = p.ticker AND x.ts = p.ts LEFT JOIN (SELECT * FROM bars WHERE v > 100) y ON y.ticker = p.ticker AND y.ts = p.ts", "w")(
    lambda s, d: P.panel_w(s, d).select("ticker", "ts", "c").join(P.bars_w(s, d).select("ticker", "ts", F.col("o").alias("a")), ["ticker", "ts"], "left").join(P.bars_w(s, d).where("v > 100").select("ticker", "ts", F.col("h").alias("b")), ["ticker", "ts"], "left")
)
query("j05_macro_by_date", f"{K} m1:d m2:d", "SELECT p.ticker, p.ts, a.value AS m1, b.value AS m2 FROM panel p LEFT JOIN macro a ON a.ts = p.ts AND a.feature = 'm1' LEFT JOIN macro b ON b.ts = p.ts AND b.feature = 'm2'", "wm")(
    lambda s, d: P.panel_w(s, d).join(R.pivot(P.macro(s, d), "ts", "feature", "value", M), "ts", "left")
)
query("j06_inner_chain", "n:l total:d", "SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")(
    lambda s, d: T(s, d, "lineitem").join(T(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
)
query("j07_left_with_suffix", "n_nationkey:l n_name n_name_meta", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_meta FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_regionkey")(
    lambda s, d: T(s, d, "nation").join(T(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n_name_meta")), F.col("n_regionkey") == F.col("k"), "left")
)
query("j08_asof_state", f"{K} state:l", "SELECT b.ticker, b.ts, coalesce(m.state, 1) AS state FROM daily b ASOF LEFT JOIN (SELECT ts, CASE WHEN value > 1000000 THEN 2 ELSE 0 END AS state FROM macro WHERE feature = 'm1') m ON b.ts >= m.ts", "md")(
    lambda s, d: J.asof(P.bars_d(s, d).select("ticker", "ts"), P.macro(s, d).where("feature = 'm1'").select("ts", F.when(F.col("value") > 1000000, 2).otherwise(0).alias("state")), "state", default=1)
)
query("j10_outer_concat", "ts:t " + " ".join(f"{m}:d" for m in M), "SELECT ts, " + ", ".join(f"max(value) FILTER (feature = '{m}') AS {m}" for m in M) + " FROM macro GROUP BY ts", "m")(
    lambda s, d: P.macro(s, d).groupBy("ts").pivot("feature", M).agg(F.max("value"))
)
query("j11_inner_concat", "ts:t a:d b:d", "SELECT a.ts, a.value AS a, b.value AS b FROM macro a JOIN macro b ON a.ts = b.ts AND a.feature = 'm1' AND b.feature = 'm2'", "m")(
    lambda s, d: P.macro(s, d).where("feature = 'm1'").select("ts", F.col("value").alias("a")).join(P.macro(s, d).where("feature = 'm2'").select("ts", F.col("value").alias("b")), "ts")
)
query("j12_first_match", "p_brand p_type p_name", "SELECT b.p_brand, m.p_type, m.p_name FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand, p_type, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name) AS k FROM part) m ON m.p_brand = b.p_brand AND m.k = 1")(
    lambda s, d: J.first_match(T(s, d, "part").select("p_brand").distinct(), T(s, d, "part").select("p_brand", "p_type", "p_name"), "p_brand", ["p_type", "p_name"])
)
query("j13_time_to_position", f"{K} at:l", "SELECT d.ticker, d.ts, coalesce(c.pos, -1) AS at FROM daily d LEFT JOIN cal c ON c.ts = d.ts", "wd")(lambda s, d: J.positions(P.bars_d(s, d), R.calendar(P.bars_w(s, d)), out="at"))
query("j15_forward_range", f"{K} n:l top:d", "SELECT a.ticker, a.ts, count(b.pos) AS n, max(b.h) AS top FROM panel a LEFT JOIN panel b ON b.ticker = a.ticker AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 GROUP BY 1, 2", "w")(
    lambda s, d: P.panel_w(s, d).withColumn("n", F.count(F.lit(1)).over(C.series().rowsBetween(1, 5))).withColumn("top", F.max("h").over(C.series().rowsBetween(1, 5)))
)
query("j16_semi_join", "n:l", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")(
    lambda s, d: T(s, d, "orders").join(T(s, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))
)


def _common(s, d):
    b = P.bars_d(s, d)
    out = b.where("ticker = 'AUTOMOBILE'").select("ts")
    for x in ("BUILDING", "HOUSEHOLD", "MACHINERY"):
        out = out.intersect(b.where(F.col("ticker") == x).select("ts"))
    return out


query("j17_index_intersection", "ts:t", "SELECT ts FROM daily WHERE ticker IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY') GROUP BY ts HAVING count(*) = 4", "d")(_common)
query("j18_aligned_fill", "ts:t x:d y:d", "SELECT coalesce(a.ts, b.ts) AS ts, coalesce(a.c, 0) AS x, coalesce(b.c, 0) AS y FROM (SELECT * FROM daily WHERE ticker = 'BUILDING') a FULL JOIN (SELECT * FROM daily WHERE ticker = 'MACHINERY') b ON a.ts = b.ts", "d")(
    lambda s, d: J.aligned(P.bars_d(s, d).where("ticker = 'BUILDING'").select("ts", F.col("c").alias("x")), P.bars_d(s, d).where("ticker = 'MACHINERY'").select("ts", F.col("c").alias("y")), ["ts"], "x", "y")
)
query("j19_multiset_gather", "p_partkey:l n:l", "SELECT p_partkey, p_size % 4 AS n FROM part WHERE p_size % 4 > 0")(
    lambda s, d: J.repeated(T(s, d, "part").select("p_partkey"), T(s, d, "part").where("p_size % 4 > 0").select("p_partkey", (F.col("p_size") % 4).alias("n_draws")), "p_partkey").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))
)

# Aggregates.
query("a01_bars", f"{K} o h l c v", "SELECT * FROM bars", "w")(P.bars_w)


def _merged(s, d):
    h = P.ticks_h(s, d).withColumn("ts", F.date_trunc("hour", "at"))
    b = A.bars_from_ticks(h)
    return A.merge_bars(b.union(b).withColumn("at", F.col("ts")).withColumn("ts", F.to_date("ts")), F.col("at"))


query("a02_resample_daily", f"{K} o:d h:d l:d c:d v:d", "SELECT ticker, CAST(ts AS DATE) AS ts, arg_min(o, ts) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts) AS c, sum(v) AS v FROM hourly GROUP BY 1, 2", "h")(_merged)
query("a03_distinct_rows", "l_returnflag l_linestatus l_linenumber:l", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")(lambda s, d: T(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates())
query("a04_keep_first", "o_custkey:l o_orderkey:l", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: A.keep_one(T(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.col("o_orderkey")))
query("a04_keep_last", "o_custkey:l o_orderkey:l", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: A.keep_one(T(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.col("o_orderkey"), last=True))
query("a05_calendar", "ts:t pos:l", "SELECT * FROM cal", "w")(lambda s, d: R.calendar(P.bars_w(s, d)))
query("a06_volatility_summary", "ticker mean:d median:d std:d min:d max:d coverage:d", 'SELECT ticker, avg(c) AS mean, quantile_cont(c, 0.5) AS median, stddev_samp(c) AS std, min(c) AS min, max(c) AS max, 100.0 * count(c) / count(*) AS coverage FROM dpanel GROUP BY 1', "d")(
    lambda s, d: A.volatility_summary(R.densify(P.bars_d(s, d)), "c")
)
query("a09_metric_rows", "metric value:d", "SELECT unnest(['mean_c', 'median_c', 'mean_v', 'median_v']) AS metric, unnest([avg(c), quantile_cont(c, 0.5), avg(v), quantile_cont(v, 0.5)]) AS value FROM bars", "w")(lambda s, d: A.metric_rows(P.bars_w(s, d), ["c", "v"]))
MISSING = """SELECT ticker, total, structural, weekend, other, coverage, CASE WHEN active = 0 THEN 'Structural Empty' WHEN weekend > other THEN 'Weekends' WHEN other > 0 THEN 'Holiday or Halt' ELSE 'Unexpected Missing' END AS cause FROM (
SELECT ticker, count(*) FILTER (c IS NULL) AS total, count(*) FILTER (c IS NULL AND NOT live) AS structural, count(*) FILTER (c IS NULL AND live AND isodow(ts) >= 6) AS weekend, count(*) FILTER (c IS NULL AND live AND isodow(ts) < 6) AS other,
 count(*) FILTER (live) AS active, 100.0 * count(c) / count(*) AS coverage FROM (SELECT *, coalesce(ts >= min(CASE WHEN c IS NOT NULL THEN ts END) OVER (PARTITION BY ticker) AND ts <= max(CASE WHEN c IS NOT NULL THEN ts END) OVER (PARTITION BY ticker), false) AS live FROM dpanel) GROUP BY 1) WHERE total > 0"""
query("a10_missing_profile", "ticker total:l structural:l weekend:l other:l coverage:d cause", MISSING, "d")(lambda s, d: A.missing_profile(R.densify(P.bars_d(s, d))))
query("a11_describe", "feature count:l mean:d std:d min:d p05:d p95:d max:d", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.95) AS p95, max({c}) AS max FROM bars" for c in ("o", "c", "v")), "w")(
    lambda s, d: A.describe(P.bars_w(s, d), ["o", "c", "v"])
)
query("a12_calendar_report", "ticker days:l start:t end:t weekends:l holidays:l", """SELECT ticker, max(days) AS days, min(s) AS start, max(e) AS "end", count(*) FILTER (isodow(x) >= 6) AS weekends, greatest(0, count(*) FILTER (isodow(x) < 6) - max(days)) AS holidays
 FROM (SELECT ticker, days, s, e, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS x FROM (SELECT ticker, count(DISTINCT ts) AS days, min(ts) AS s, max(ts) AS e FROM daily GROUP BY 1)) GROUP BY 1""", "d")(lambda s, d: A.calendar_report(P.bars_d(s, d)))
query("a13_fingerprint", "rows:l columns:l start:s end:s md5", """SELECT count(*) AS "rows", 3 AS columns, CAST(min(ts) AS VARCHAR) AS start, CAST(max(ts) AS VARCHAR) AS "end", md5(concat_ws('|', CAST(count(*) AS VARCHAR), '3', 'ticker,ts,c', CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR))) AS md5 FROM daily""", "d")(
    lambda s, d: A.fingerprint(P.bars_d(s, d).select("ticker", "ts", "c"))
)
query("a14_lifetimes", "ticker first_valid:t last_valid:t active_days:l coverage:d", "SELECT ticker, min(ts) FILTER (c IS NOT NULL) AS first_valid, max(ts) FILTER (c IS NOT NULL) AS last_valid, count(c) AS active_days, 100.0 * count(c) / count(*) AS coverage FROM dpanel GROUP BY 1", "d")(
    lambda s, d: A.lifetimes(R.densify(P.bars_d(s, d)))
)
query("a15_feature_diagnostics", "feature missing_pct:d std:d constant:b", " UNION ALL ".join(f"SELECT '{c}' AS feature, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct, stddev_samp({c}) AS std, min({c}) = max({c}) AS constant FROM dpanel" for c in ("o", "h", "c", "v")), "d")(
    lambda s, d: A.feature_diagnostics(R.densify(P.bars_d(s, d)), ["o", "h", "c", "v"])
)


def _holes(s, d):
    """The daily panel with values missing in one column at a time."""
    keep = lambda c, cond: F.when(cond, F.col(c))
    day = F.dayofmonth("ts")
    return R.densify(P.bars_d(s, d)).withColumns({"o": keep("o", day != 13), "h": keep("h", day != 7), "c": keep("c", F.weekday("ts") != 2)})


PAIRS = [(a, b) for i, a in enumerate("ohlc") for b in "ohlc"[i + 1 :]]
query("a16_correlations", "a b corr:d", f"WITH g AS (SELECT CASE WHEN day(ts) <> 13 THEN o END AS o, CASE WHEN day(ts) <> 7 THEN h END AS h, l, CASE WHEN isodow(ts) <> 3 THEN c END AS c FROM dpanel), k AS (SELECT * FROM g WHERE o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM k" for a, b in PAIRS), "d")(
    lambda s, d: A.correlations(_holes(s, d), list("ohlc"), complete=True)
)
query("a16_pairwise_correlations", "a b corr:d", f"WITH g AS (SELECT CASE WHEN day(ts) <> 13 THEN o END AS o, CASE WHEN day(ts) <> 7 THEN h END AS h, l, CASE WHEN isodow(ts) <> 3 THEN c END AS c FROM dpanel) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM g" for a, b in PAIRS), "d")(
    lambda s, d: A.correlations(_holes(s, d), list("ohlc"))
)
query("a17_shares", "l_returnflag n:l share:d", "SELECT l_returnflag, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1")(lambda s, d: A.shares(T(s, d, "lineitem"), "l_returnflag"))
query("a27_duplicate_keys", "l_orderkey:l l_linenumber:l n:l", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: A.duplicate_keys(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]))
BAD = "(SELECT ticker, ts, CASE WHEN isodow(ts) = 3 THEN c - 1 ELSE h END AS h, CASE WHEN isodow(ts) = 4 THEN c + 1 ELSE l END AS l, CASE WHEN day(ts) = 13 THEN -1 ELSE o END AS o, c, v FROM daily)"
VIOLATIONS = f"""SELECT rule, n, array_to_string(ex, ',') AS examples FROM (SELECT rule, count(*) AS n, list_slice(list(k ORDER BY k), 1, 5) AS ex FROM (SELECT ticker || '@' || CAST(ts AS VARCHAR) AS k, unnest(list_filter([CASE WHEN h < greatest(o, c) THEN 'high' END, CASE WHEN l > least(o, c) THEN 'low' END,
 CASE WHEN o <= 0 OR c <= 0 THEN 'price' END, CASE WHEN v < 0 THEN 'volume' END], lambda x: x IS NOT NULL)) AS rule FROM {BAD}) GROUP BY rule)"""


def _broken(s, d):
    wd = F.dayofweek("ts")
    b = P.bars_d(s, d)
    return b.withColumns({"h": F.when(wd == 4, F.col("c") - 1).otherwise(F.col("h")), "l": F.when(wd == 5, F.col("c") + 1).otherwise(F.col("l")), "o": F.when(F.dayofmonth("ts") == 13, -1.0).otherwise(F.col("o"))})


query("a28_violations", "rule n:l examples", VIOLATIONS, "d")(lambda s, d: A.violations(_broken(s, d)))


def _report(s, d):
    found = A.violations(_broken(s, d))
    path = folder(found)
    files.write_report(found, path)
    return s.read.text(path).withColumnRenamed("value", "line")


query("s15_text_report", "line", f"SELECT '[' || rule || '] ' || n AS line FROM ({VIOLATIONS}) UNION ALL SELECT '  e.g. ' || examples FROM ({VIOLATIONS})", "d")(_report)
query("a29_missing_ranking", "ticker missing:l", "SELECT ticker, count(*) FILTER (c IS NULL) AS missing FROM panel GROUP BY 1", "w")(lambda s, d: A.missing_ranking(P.panel_w(s, d)))
query("a30_tail_mean", "ticker q:d tail:d", "SELECT ticker, max(q) AS q, avg(c) AS tail FROM (SELECT b.ticker, b.c, g.q FROM bars b JOIN (SELECT ticker, quantile_cont(c, 0.05) AS q FROM bars GROUP BY 1) g USING (ticker)) WHERE c <= q GROUP BY 1", "w")(lambda s, d: A.tail_mean(P.bars_w(s, d), "c"))
query("a30_moments", "ticker cov:d corr:d", "SELECT ticker, covar_samp(c / 1000, v) AS cov, corr(c / 1000, v) AS corr FROM bars GROUP BY 1", "w")(lambda s, d: A.moments(P.bars_w(s, d).withColumn("c", F.col("c") / 1000), "c", "v"))

# Order, limits and sets.
query("o01_sorted_rank", f"{K} c:d pos:l", f"SELECT *, row_number() {W} AS pos FROM bars", "w")(lambda s, d: P.bars_w(s, d).withColumn("pos", F.row_number().over(C.series())).orderBy("ticker", "ts"))
query("o03_sorted_by_metric", "ticker missing:l place:l", "SELECT ticker, missing, row_number() OVER (ORDER BY missing DESC, ticker) AS place FROM (SELECT ticker, count(*) FILTER (c IS NULL) AS missing FROM panel GROUP BY 1)", "w")(
    lambda s, d: A.missing_ranking(P.panel_w(s, d)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("missing"), "ticker")))
)
query("o04_top_bars", f"{K} c:d", "SELECT ticker, ts, c FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY c DESC, ts) AS k FROM bars) WHERE k <= 5", "w")(
    lambda s, d: P.bars_w(s, d).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("c"), "ts"))).where("k <= 5")
)
query("u01_union_by_name", "ticker n:l", "SELECT ticker, count(*) AS n FROM (SELECT ticker FROM daily UNION ALL SELECT event_type FROM events) GROUP BY 1", "d")(
    lambda s, d: P.bars_d(s, d).select("ticker").unionByName(P.ticks_h(s, d).select("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
)
query("u02_key_union", "k:l", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)")(lambda s, d: T(s, d, "orders").select(F.col("o_custkey").alias("k")).union(T(s, d, "customer").select("c_custkey")).distinct())
query("u03_key_intersect", "k:l", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")(lambda s, d: T(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(T(s, d, "customer").select("c_custkey")))
query("u04_key_difference", "k:l", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")(
    lambda s, d: T(s, d, "customer").select(F.col("c_custkey").alias("k")).join(T(s, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k")), "k", "left_anti")
)

# Scalars.
query("f01_math", f"{K} a:d b:d e:d g:l", "SELECT ticker, ts, ln(c) AS a, sqrt(abs(o - c)) AS b, exp(-v / 100) AS e, CAST(trunc(v * 0.01) AS BIGINT) AS g FROM bars", "w")(
    lambda s, d: P.bars_w(s, d).withColumns({"a": C.log(F.col("c")), "b": F.sqrt(F.abs(F.col("o") - F.col("c"))), "e": F.exp(-F.col("v") / 100), "g": (F.col("v") * 0.01).cast("int")})
)
query("f02_strings", "p_partkey:l slug sym", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(trim(' ' || p_brand || '.B '), '.', '-') AS sym FROM part")(
    lambda s, d: T(s, d, "part").select("p_partkey", C.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), C.symbol(F.concat(F.lit(" "), "p_brand", F.lit(".B "))).alias("sym"))
)
query("f03_dates", "event_id:l day:t weekday:l month_end:t", "SELECT event_id, CAST(ts AS DATE) AS day, isodow(ts) - 1 AS weekday, last_day(CAST(ts AS DATE)) AS month_end FROM events")(
    lambda s, d: T(s, d, "events").select("event_id", F.to_date("ts").alias("day"), F.weekday("ts").alias("weekday"), F.last_day("ts").alias("month_end"))
)
query("f04_valid_span", "ticker a:t b:t", "SELECT ticker, min(ts) FILTER (c IS NOT NULL) AS a, max(ts) FILTER (c IS NOT NULL) AS b FROM panel GROUP BY 1", "w")(
    lambda s, d: P.panel_w(s, d).groupBy("ticker").agg(F.min(F.when(F.col("c").isNotNull(), F.col("ts"))).alias("a"), F.max(F.when(F.col("c").isNotNull(), F.col("ts"))).alias("b"))
)
query("f05_md5", "s_suppkey:l h", "SELECT s_suppkey, md5(s_name) AS h FROM supplier")(lambda s, d: T(s, d, "supplier").select("s_suppkey", F.md5(F.col("s_name").cast("binary")).alias("h")))
query("f06_basis_points", "o_orderkey:l cost:d", "SELECT o_orderkey, o_totalprice * 7 / 10000 AS cost FROM orders")(lambda s, d: T(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") * C.basis_points(F.lit(7.0))).alias("cost")))
query("schema_detection", "dataset kind", "SELECT unnest(['long', 'ohlcv', 'single', 'multi']) AS dataset, unnest(['Equity_Long', 'OHLCV', 'Single_Numeric', 'Multi_Numeric']) AS kind")(
    lambda s, d: s.createDataFrame(
        [(n, str(schema.detect(P.bars_d(s, d).select(F.col("ts").alias("Date"), *c)).value)) for n, c in {
            "long": [F.col("ticker").alias("Ticker"), F.col("c").alias("Close")], "ohlcv": [F.col(a).alias(b) for a, b in zip("ohlc", ("Open", "High", "Low", "Close"), strict=True)],
            "single": [F.col("c").alias("x")], "multi": [F.col("c").alias("x"), F.col("v").alias("y")]}.items()], "dataset string, kind string")
)
