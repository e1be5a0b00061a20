"""Schema detection, normalisation and validation of raw market tables. Detection reads the schema alone."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import clean, new_york_day
from quantloom.operators import reshape as R


class Kind(StrEnum):
    WIDE = "Equity_Wide_MultiIndex"
    LONG = "Equity_Long"
    OHLCV = "OHLCV"
    SINGLE = "Single_Numeric"
    MULTI = "Multi_Numeric"


TIME = ("date", "datetime", "time", "timestamp")
TICKER = ("ticker", "symbol", "asset")


def _first(df: DataFrame, names: tuple[str, ...]) -> str | None:
    low = {c.lower(): c for c in reversed(df.columns)}
    return next((low[n] for n in names if n in low), None)


def time_column(df: DataFrame) -> str | None:
    return _first(df, TIME)


def ticker_column(df: DataFrame) -> str | None:
    return _first(df, TICKER)


def detect(df: DataFrame, sep: str = "|") -> Kind:
    """Two-level names, then a ticker column, then all of open, high, low, close, then one or more numbers."""
    low = {c.lower() for c in df.columns}
    if any(sep in c for c in df.columns):
        return Kind.WIDE
    if low & set(TICKER):
        return Kind.LONG
    if {"open", "high", "low", "close"} <= low:
        return Kind.OHLCV
    return Kind.SINGLE if len(R.numeric_columns(df, tuple(c for c in df.columns if c.lower() in TIME))) == 1 else Kind.MULTI


def normalise(df: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Canonical bars (ticker, ts, o, h, l, c, v): names and types fixed, adjusted columns and null dates gone, midnight of the exchange."""
    d = R.drop_adjusted(R.rename_canonical(df))
    time, who = time_column(d), ticker_column(d)
    if time is None:
        raise ValueError("no time column")
    number = lambda c: clean(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    pick = lambda c, a: (number(c) if c in d.columns else F.lit(None).cast("double")).alias(a)
    ts = F.to_date(new_york_day(F.expr(f"try_cast(`{time}` AS TIMESTAMP)"), zone))
    return d.select(
        (F.col(who) if who else F.lit(None)).cast("string").alias("ticker"), ts.alias("ts"), pick("Open", "o"), pick("High", "h"), pick("Low", "l"), pick("Close", "c"),
        (F.expr("try_cast(`Volume` AS BIGINT)") if "Volume" in d.columns else F.lit(None).cast("bigint")).alias("v"),
    ).where("ts IS NOT NULL")


def hard_faults(df: DataFrame) -> list[str]:
    """Reasons to leave a table out: repeated column names, at most one row, repeated keys."""
    out = []
    low = [c.lower() for c in df.columns]
    if len(set(low)) < len(low):
        return ["duplicate columns"]
    if len(df.limit(2).collect()) < 2:
        out.append("too few rows")
    keys = [c for c in (time_column(df), ticker_column(df)) if c]
    if keys and not df.groupBy(*keys).count().where("count > 1").isEmpty():
        out.append("duplicate keys")
    return out
