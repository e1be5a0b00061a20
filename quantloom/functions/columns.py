"""Column functions with the null rules of the engine: no NaN, no error on zero, guarded logarithms."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN becomes null; done once, at the scan."""
    return F.when(~F.isnan(x), x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def series(group: str = "ticker", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(group).orderBy(order)


def rolling(agg, x: Column, n: int, w: WindowSpec, shift: int = 0) -> Column:
    """``agg`` over the last ``n`` rows, null unless all of them hold a value."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def expanding(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(expanding(w))


def slugify(x: Column) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def symbol(x: Column) -> Column:
    """Exchange symbols: trimmed, dots as dashes; empty and 'nan' become null."""
    s = F.regexp_replace(F.trim(x), r"\.", "-")
    return F.when((s != "") & (F.lower(s) != "nan"), s)


def basis_points(x: Column) -> Column:
    return x / 10000.0


def first_argmax(values: list[Column]) -> Column:
    """Place of the largest value; the first of equals."""
    a = F.array(*values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def new_york_day(x: Column, zone: str = "America/New_York") -> Column:
    """Midnight of the exchange's day of a UTC timestamp."""
    return F.date_trunc("day", F.from_utc_timestamp(x, zone))
