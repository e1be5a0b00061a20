"""Recursions over series that windows cannot express: exponential weights and the cumulative-sum filter.

A task holds whole series, one after another in order of time, and goes through all of them side by side, row by row: step t is
one array operation over the t-th rows of its series. A series has as many rows as the calendar has dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "ticker string, ts date, price double, ret double, vol double, threshold double, direction string"
FEW = 16  # with fewer series than these a loop over plain numbers is faster
ROWS = 200_000  # rows that a task gathers before it works on them


def _ewm_std(x: np.ndarray, span: float) -> np.ndarray:
    keep = 1 - 2 / (span + 1)
    out = np.full(len(x), np.nan)
    w = w2 = mean = m2 = 0.0
    last = np.nan
    for i, v in enumerate(x):
        w, w2, m2 = w * keep, w2 * keep * keep, m2 * keep
        if v == v:
            new = w + 1
            delta = v - mean
            mean += delta / new
            m2 += w * delta * delta / new
            w, w2 = new, w2 + 1
            room = w * w - w2
            last = np.sqrt(max(m2, 0.0) * w / room) if room > 1e-12 * w * w else np.nan
        out[i] = last
    return out


def _ema(x: np.ndarray, span: float) -> np.ndarray:
    a = 2 / (span + 1)
    out = np.full(len(x), np.nan)
    y, past = np.nan, 1.0
    for i, v in enumerate(x):
        if y == y:
            past *= 1 - a
        if v == v:
            y = v if y != y else (past * y + a * v) / (past + a)
            past = 1.0
        out[i] = y
    return out


def cusum(ret: np.ndarray, vol: np.ndarray, multiplier: float = 1.0) -> Iterator[tuple[int, float, bool]]:
    """(row, threshold, upward) where the sum of returns since the last event passes the threshold; each side resets alone."""
    up = down = 0.0
    for i in range(1, len(ret)):
        r, v = ret[i], vol[i]
        if not (r == r and v == v and v > 1e-8):
            continue
        h = v * multiplier
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up > h:
            up = 0.0
            yield i, h, True
        elif down < -h:
            down = 0.0
            yield i, h, False


def _steps(starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Rows of each step: the t-th of every series that has one, longest series first."""
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")
    first, falling = starts[order], -sizes[order]
    for t in range(-int(falling[0]) if len(falling) else 0):
        yield first[: np.searchsorted(falling, -t, side="left")] + t


def _each(f: Callable, starts: np.ndarray, *columns: np.ndarray):
    """``f`` of the rows of each series, put together."""
    ends = [*starts[1:].tolist(), len(columns[0])]
    return np.concatenate([f(*[x[a:b] for x in columns]) for a, b in zip(starts.tolist(), ends, strict=True)]) if len(starts) else np.zeros(0)


def ewm_std(x: np.ndarray, span: float, starts: np.ndarray | None = None) -> np.ndarray:
    """Bias-corrected deviation with weights (1 - a)^age; a null row ages the weights and repeats the last value.

    ``starts`` are the first rows of the series in ``x``.
    """
    starts = np.zeros(1, np.int64) if starts is None else starts
    if len(starts) < FEW:
        return _each(lambda v: _ewm_std(v, span), starts, x)
    keep = 1 - 2 / (span + 1)
    out = np.empty(len(x))
    w, w2, mean, m2 = np.zeros((4, len(starts)))
    last = np.full(len(starts), np.nan)
    for rows in _steps(starts, len(x)):
        m = len(rows)
        v = x[rows]
        ok = v == v
        aged, aged2, spread = w[:m] * keep, w2[:m] * (keep * keep), m2[:m] * keep
        new = aged + 1
        delta = np.where(ok, v - mean[:m], 0)
        mean[:m] += delta / new
        m2[:m] = spread + aged * delta * delta / new
        w[:m], w2[:m] = np.where(ok, new, aged), np.where(ok, aged2 + 1, aged2)
        square = w[:m] * w[:m]
        room = square - w2[:m]
        fine = room > 1e-12 * square
        now = np.where(fine, np.sqrt(np.maximum(m2[:m], 0) * w[:m] / np.where(fine, room, 1)), np.nan)
        last[:m] = np.where(ok, now, last[:m])
        out[rows] = last[:m]
    return out


def ema(x: np.ndarray, span: float, starts: np.ndarray | None = None) -> np.ndarray:
    """Recursive mean, y = (1 - a) y + a x; over a gap the weight of the past goes on ageing."""
    starts = np.zeros(1, np.int64) if starts is None else starts
    if len(starts) < FEW:
        return _each(lambda v: _ema(v, span), starts, x)
    a = 2 / (span + 1)
    out, y, past = np.empty(len(x)), np.full(len(starts), np.nan), np.ones(len(starts))
    for rows in _steps(starts, len(x)):
        m = len(rows)
        v, old = x[rows], y[:m]
        ok, known = v == v, old == old
        aged = np.where(known, past[:m] * (1 - a), past[:m])
        y[:m] = np.where(ok, np.where(known, (aged * old + a * v) / (aged + a), v), old)
        past[:m] = np.where(ok, 1.0, aged)
        out[rows] = y[:m]
    return out


def cusum_all(ret: np.ndarray, vol: np.ndarray, starts: np.ndarray, multiplier: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, thresholds, upward) of the events of all series; see ``cusum``."""
    if len(starts) < FEW:
        found = [(a + i, h, u) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ret)], strict=True) for i, h, u in cusum(ret[a:b], vol[a:b], multiplier)]
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found]), np.array([f[2] for f in found], bool)
    up, down = np.zeros((2, len(starts)))
    side = np.zeros(len(ret), np.int8)
    for t, rows in enumerate(_steps(starts, len(ret))):
        if not t:
            continue
        m = len(rows)
        r, v = ret[rows], vol[rows]
        ok = (r == r) & (v > 1e-8)
        h = v * multiplier
        a, b = np.where(ok, np.maximum(0, up[:m] + r), up[:m]), np.where(ok, np.minimum(0, down[:m] + r), down[:m])
        above = ok & (a > h)
        below = ok & ~above & (b < -h)
        up[:m], down[:m] = np.where(above, 0, a), np.where(below, 0, b)
        side[rows] = above.astype(np.int8) - below
    at = np.flatnonzero(side)
    return at, vol[at] * multiplier, side[at] > 0


def _whole(batches: Iterable[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole series, with the first row of each; series come one after another."""

    def starts(table: pa.Table) -> np.ndarray:
        key = table.column(group).combine_chunks()
        a, b = key.slice(1), key.slice(0, max(0, len(key) - 1))
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        return np.flatnonzero(np.r_[True, other])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, int(at[-1])), at[:-1]
            rest = table.slice(int(at[-1]))  # the last series may go on
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows if len(at) > 1 else 0
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        yield table, starts(table)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).fill_null(np.nan).to_numpy()


def _over_series(df: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, group: str, ts: str) -> DataFrame:
    dealt = df.repartition(F.col(f"`{group}`")).sortWithinPartitions(group, ts)

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, group):
            yield from run(table, starts).combine_chunks().to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(go, schema)


def _more(df: DataFrame, names: list[str]) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` double" for c in names)])


def _column(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)  # NaN is null


def by_series(df: DataFrame, columns: dict[str, tuple[str, Callable]], group: str = "ticker", ts: str = "ts") -> DataFrame:
    """``df`` with recursive columns: name -> (input column, function of its values and of the first rows of the series)."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        for name, (source, f) in columns.items():
            table = table.append_column(name, _column(f(_numbers(table, source), starts)))
        return table

    return _over_series(df, run, _more(df, list(columns)), group, ts)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal and histogram as shares of the price."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        c = _numbers(table, "c")
        line = ema(c, fast, starts) - ema(c, slow, starts)
        mean = ema(line, signal, starts)
        price = np.where(c == 0, np.nan, c)
        for name, x in (("macd", line), ("macd_signal", mean), ("macd_hist", line - mean)):
            table = table.append_column(name, _column(x / price))
        return table

    return _over_series(df, run, _more(df, ["macd", "macd_signal", "macd_hist"]), "ticker", "ts")


def cusum_events(df: DataFrame, span: float = 100, multiplier: float = 1.0) -> DataFrame:
    """Events of (ticker, ts, c, ret): deviation and filter in one pass over a series."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ret = _numbers(table, "ret")
        vol = ewm_std(ret, span, starts)
        at, h, up = cusum_all(ret, vol, starts, multiplier)
        e = table.take(pa.array(at))
        kind = pa.array(np.where(up, "Positive", "Negative"), pa.string())
        return pa.table([e.column("ticker"), e.column("ts"), e.column("c").cast(pa.float64()), _column(ret[at]), _column(vol[at]), _column(h), kind], names=["ticker", "ts", "price", "ret", "vol", "threshold", "direction"])

    return _over_series(df.select("ticker", "ts", "c", "ret"), run, EVENTS, "ticker", "ts")
