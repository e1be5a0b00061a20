"""The cumulative-sum filter over a stream of returns: the same events as in batch, bar by bar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.recursive import EVENTS

STATE = "rows long, w double, w2 double, mean double, m2 double, up double, down double"


def _step(state: tuple, r: float, keep: float, multiplier: float) -> tuple[tuple, float, float, str | None]:
    rows, w, w2, mean, m2, up, down = state
    w, w2, m2 = w * keep, w2 * keep * keep, m2 * keep
    if r == r:
        new = w + 1
        delta = r - mean
        mean += delta / new
        m2 += w * delta * delta / new
        w, w2 = new, w2 + 1
    room = w * w - w2
    vol = float(np.sqrt(max(m2, 0.0) * w / room)) if room > 1e-12 * w * w else float("nan")
    event = None
    if rows and r == r and vol == vol and vol > 1e-8:
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up > vol * multiplier:
            up, event = 0.0, "Positive"
        elif down < -vol * multiplier:
            down, event = 0.0, "Negative"
    return (rows + 1, w, w2, mean, m2, up, down), vol, vol * multiplier, event


def cusum_stream(bars: DataFrame, span: float = 100, multiplier: float = 1.0) -> DataFrame:
    """Events from a stream (ticker, ts, c, ret) whose bars arrive in order for each ticker; state is seven numbers a ticker."""
    keep = 1 - 2 / (span + 1)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        out = []
        for row in pd.concat(list(parts)).sort_values("ts", kind="stable").itertuples():
            r = float(row.ret) if row.ret is not None else float("nan")
            now, vol, h, event = _step(now, r, keep, multiplier)
            if event:
                out.append((key[0], row.ts, row.c, r, vol, h, event))
        state.update(now)
        yield pd.DataFrame(out, columns=["ticker", "ts", "price", "ret", "vol", "threshold", "direction"])

    return bars.select("ticker", "ts", "c", "ret").groupBy("ticker").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly bars of a stream (ticker, at, px, q, ord) under a watermark; a bar comes out once it is complete."""
    t = ticks.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "ticker")
    b = t.agg(F.min_by("px", "ord").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "ord").alias("c"), F.sum("q").alias("v"))
    return b.select("ticker", F.col("window.start").alias("ts"), "o", "h", "l", "c", "v")
