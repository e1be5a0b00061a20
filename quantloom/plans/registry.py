"""One registration gives a query and its SQL the same columns, types and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}  # the SQL of a query after its common tables

DIGITS = 6
# Kinds of columns: d rounded double, none as it is, l long, s string, t date as text, b boolean.
SPARK = {"l": "bigint", "s": "string", "t": "string", "b": "boolean"}
SQL = {"l": "BIGINT", "s": "VARCHAR", "t": "VARCHAR", "b": "BOOLEAN"}

BARS_W = """
tw AS (SELECT p.p_brand AS ticker, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS ts, l.l_extendedprice / l.l_quantity AS px, l.l_quantity AS q,
  (CAST(l.l_shipdate AS DATE), l.l_orderkey, l.l_linenumber, l.l_partkey % 10000) AS ord
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 0),
bars AS (SELECT ticker, ts, arg_min(px, ord) AS o, max(px) AS h, min(px) AS l, arg_max(px, ord) AS c, sum(q) AS v FROM tw GROUP BY ticker, ts),
cal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM bars)),
panel AS (SELECT t.ticker, cal.ts, cal.pos, b.o, b.h, b.l, b.c, b.v FROM cal CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.ticker = t.ticker AND b.ts = cal.ts)
"""
BARS_D = """
td AS (SELECT c.c_mktsegment AS ticker, CAST(o.o_orderdate AS DATE) AS ts, o.o_totalprice AS px, o.o_orderkey AS ord
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
daily AS (SELECT ticker, ts, arg_min(px, ord) AS o, max(px) AS h, min(px) AS l, arg_max(px, ord) AS c, CAST(count(*) AS DOUBLE) AS v FROM td GROUP BY ticker, ts),
dcal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM daily)),
dpanel AS (SELECT t.ticker, dcal.ts, dcal.pos, b.o, b.h, b.l, b.c, b.v FROM dcal CROSS JOIN (SELECT DISTINCT ticker FROM daily) t LEFT JOIN daily b ON b.ticker = t.ticker AND b.ts = dcal.ts)
"""
BARS_H = """
hourly AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c,
  CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)
"""
MACRO = """
macro AS (SELECT CAST(o_orderdate AS DATE) AS ts, 'm' || substr(o_orderpriority, 1, 1) AS feature, CAST(sum(CAST(o_totalprice * 100 AS DECIMAL(20, 0))) / 100 AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
"""
RETURNS = """
ret AS (SELECT b.ticker, b.ts, b.c, CASE WHEN b.c / p.c > 0 THEN ln(b.c / p.c) END AS ret, row_number() OVER (PARTITION BY b.ticker ORDER BY b.ts) AS rn
  FROM bars b ASOF JOIN bars p ON b.ticker = p.ticker AND b.ts - INTERVAL 1 DAY > p.ts),
ew AS (SELECT a.ticker, a.rn, sum(pow(1 - 2 / 101.0, a.rn - b.rn)) AS w, sum(pow(1 - 2 / 101.0, a.rn - b.rn) * b.ret) AS wx, sum(pow(1 - 2 / 101.0, a.rn - b.rn) * b.ret * b.ret) AS wxx,
  sum(pow(1 - 2 / 101.0, 2 * (a.rn - b.rn))) AS w2 FROM ret a JOIN ret b ON a.ticker = b.ticker AND b.rn <= a.rn AND b.ret IS NOT NULL GROUP BY 1, 2),
vol AS (SELECT r.*, CASE WHEN e.w * e.w - e.w2 > 1e-12 * e.w * e.w THEN sqrt(greatest(e.wxx / e.w - (e.wx / e.w) * (e.wx / e.w), 0) * e.w * e.w / (e.w * e.w - e.w2)) END AS vol
  FROM ret r LEFT JOIN ew e ON e.ticker = r.ticker AND e.rn = r.rn)
"""
EVENTS = """
st AS (
  SELECT ticker, CAST(1 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(NULL AS VARCHAR) AS direction FROM vol WHERE rn = 1
  UNION ALL
  SELECT s.ticker, v.rn,
    CASE WHEN v.ret IS NULL OR v.vol IS NULL OR v.vol <= 1e-8 THEN s.up WHEN greatest(0, s.up + v.ret) > v.vol THEN 0 ELSE greatest(0, s.up + v.ret) END,
    CASE WHEN v.ret IS NULL OR v.vol IS NULL OR v.vol <= 1e-8 THEN s.down WHEN greatest(0, s.up + v.ret) > v.vol THEN least(0, s.down + v.ret) WHEN least(0, s.down + v.ret) < -v.vol THEN 0 ELSE least(0, s.down + v.ret) END,
    CASE WHEN v.ret IS NULL OR v.vol IS NULL OR v.vol <= 1e-8 THEN NULL WHEN greatest(0, s.up + v.ret) > v.vol THEN 'Positive' WHEN least(0, s.down + v.ret) < -v.vol THEN 'Negative' END
  FROM st s JOIN vol v ON v.ticker = s.ticker AND v.rn = s.rn + 1),
ev AS (SELECT v.ticker, v.ts, v.c AS price, v.ret, v.vol, v.vol AS threshold, s.direction FROM st s JOIN vol v ON v.ticker = s.ticker AND v.rn = s.rn WHERE s.direction IS NOT NULL)
"""
def labels_sql(policy: str = "conservative") -> str:
    up, down = "coalesce(coalesce({0}.h, {0}.c) >= e.pt, false)", "coalesce(coalesce({0}.l, {0}.c) <= e.sl, false)"
    touch = f"{up} <> {down}" if policy == "ignore" else f"({up} OR {down})"
    loss = f"NOT {up}" if policy == "optimistic" else down
    return f"""
eb AS (SELECT e.ticker, e.ts, p.pos, p.c AS price, e.vol, p.c * (1 + e.vol) AS pt, p.c * (1 - e.vol) AS sl FROM ev e JOIN panel p ON p.ticker = e.ticker AND p.ts = e.ts),
hp AS (SELECT e.ticker, e.ts, max(p.pos) AS last, min(p.pos) FILTER ({touch.format('p')}) AS hit
  FROM eb e JOIN panel p ON p.ticker = e.ticker AND p.pos BETWEEN e.pos + 1 AND e.pos + 5 GROUP BY 1, 2),
lx AS (SELECT e.*, h.last, h.hit AS hitpos, x.ts AS hit_ts, z.ts AS last_ts, z.c AS last_c, CASE WHEN h.hit IS NULL THEN 3 WHEN {loss.format('x')} THEN 2 ELSE 1 END AS code
  FROM eb e LEFT JOIN hp h ON h.ticker = e.ticker AND h.ts = e.ts LEFT JOIN panel x ON x.ticker = e.ticker AND x.pos = h.hit LEFT JOIN panel z ON z.ticker = e.ticker AND z.pos = h.last),
lab0 AS (SELECT ticker, ts, pos, price, pt, sl, vol, coalesce(last_ts, ts) AS vertical_ts, CASE WHEN code = 3 THEN coalesce(last_ts, ts) ELSE hit_ts END AS exit_ts,
  CASE code WHEN 1 THEN pt WHEN 2 THEN sl ELSE CASE WHEN last_ts IS NULL THEN price ELSE last_c END END AS exit_price, CASE code WHEN 1 THEN 'PT' WHEN 2 THEN 'SL' ELSE 'VERTICAL' END AS hit,
  CASE code WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS label FROM lx WHERE vol > 0 AND price > 0),
lab AS (SELECT *, exit_ts - ts AS holding, CASE WHEN exit_price / price > 0 THEN ln(exit_price / price) END AS ret FROM lab0 WHERE exit_price IS NOT NULL)
"""


LABELS = labels_sql()
UNIQUE = """
step AS (SELECT pos, sum(d) AS d FROM (SELECT c.pos, 1 AS d FROM lab l JOIN cal c ON c.ts = l.ts UNION ALL SELECT c.pos + 1, -1 FROM lab l JOIN cal c ON c.ts = l.exit_ts) GROUP BY pos),
conc AS (SELECT c.ts, c.pos, CAST(sum(coalesce(s.d, 0)) OVER (ORDER BY c.pos) AS BIGINT) AS n FROM cal c LEFT JOIN step s ON s.pos = c.pos),
uniq AS (SELECT l.ticker, l.ts, l.exit_ts, l.price, l.exit_price, avg(CASE WHEN c.n > 0 THEN 1.0 / c.n ELSE 0 END) AS uniqueness
  FROM lab l JOIN conc c ON c.ts BETWEEN l.ts AND l.exit_ts GROUP BY ALL)
"""

PRELUDES = {
    "": [], "w": [BARS_W], "d": [BARS_D], "h": [BARS_H], "m": [MACRO], "md": [MACRO, BARS_D], "ret": [BARS_W, RETURNS], "ev": [BARS_W, RETURNS, EVENTS],
    "lab": [BARS_W, RETURNS, EVENTS, LABELS], "uniq": [BARS_W, RETURNS, EVENTS, LABELS, UNIQUE], "wm": [BARS_W, MACRO], "wd": [BARS_W, BARS_D], "optimistic": [BARS_W, RETURNS, EVENTS, labels_sql("optimistic")], "ignore": [BARS_W, RETURNS, EVENTS, labels_sql("ignore")],
}
BARS_P = BARS_W.replace("p.p_brand AS ticker", "'P' || CAST(l.l_partkey AS VARCHAR) AS ticker")
PRELUDES |= {"wide": [BARS_P, RETURNS, EVENTS, labels_sql()]}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(c.split(":")[0], c.split(":")[1] if ":" in c else "") for c in spec.split()]


def tidy(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(f"`{name}`")
        c = c.cast("date") if kind == "t" else c
        out.append((F.round(c.cast("double"), DIGITS) if kind == "d" else c.cast(SPARK[kind]) if kind else c).alias(name))
    return df.select(*out)


def tidy_sql(body: str, spec: str, prelude: str) -> str:
    out = []
    for name, kind in _columns(spec):
        q = f'"{name}"'
        r = f"round(CAST({q} AS DOUBLE), {DIGITS})"
        out.append(f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {q}" if kind == "d" else f"CAST({f'CAST({q} AS DATE)' if kind == 't' else q} AS {SQL[kind]}) AS {q}" if kind else q)
    parts = ",\n".join([*PRELUDES[prelude], f"body AS ({body})"])
    return f"WITH RECURSIVE {parts}\nSELECT {', '.join(out)} FROM body"


def query(name: str, columns: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` selects the same columns after the common tables that ``uses`` names."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir), columns)
        if sql:
            ORACLES[name], BODIES[name] = tidy_sql(sql, columns, uses), sql
        return f

    return add
