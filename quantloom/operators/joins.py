"""Joins that need more than one call: as-of, lookup and gathers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, value: str, ts: str = "ts", default=None, by: list[str] | None = None) -> DataFrame:
    """Each left row with the last ``value`` of ``right`` at or before its time: one union and one window, no range join.

    The window sees the distinct times of a key only, so without ``by`` it is as long as the calendar.
    """
    by = by or []
    kind = right.schema[value].dataType
    a = left.select(*by, F.col(ts).alias("__t")).distinct().withColumn("__k", F.lit(1)).withColumn("__v", F.lit(None).cast(kind))
    b = right.select(*by, F.col(ts).alias("__t"), F.lit(0).alias("__k"), F.col(value).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__k = 1")
    out = left.join(found.select(*by, F.col("__t").alias(ts), value), [*by, ts], "left")
    if default is not None:
        out = out.withColumn(value, F.coalesce(value, F.lit(default)))
    return out.select(*left.columns, value)


def first_match(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left rows with the columns of one right row of the same key, the least by value."""
    one = right.groupBy(key).agg(F.min(F.struct(*columns)).alias("__m")).select(key, "__m.*")
    return left.join(one, key, "left")


def positions(df: DataFrame, calendar: DataFrame, ts: str = "ts", out: str = "pos", strict: bool = False) -> DataFrame:
    """Place of a time in the calendar, -1 if it is not there (an error with ``strict``)."""
    p = F.coalesce("__p", F.lit(-1))
    if strict:
        p = F.coalesce(F.col("__p"), F.raise_error(F.lit("time is not in the calendar")).cast("long"))
    return df.join(calendar.select(F.col("ts").alias(ts), F.col("pos").alias("__p")), ts, "left").withColumn(out, p).drop("__p")


def repeated(df: DataFrame, draws: DataFrame, key: str, n: str = "n_draws") -> DataFrame:
    """Each row once for each draw of its key."""
    return df.join(draws, key).withColumn("__r", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop("__r", n)


def aligned(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Full outer join on the keys; what is missing is zero."""
    j = a.select(*keys, x).join(b.select(*keys, y), keys, "full_outer")
    return j.select(*keys, F.coalesce(x, F.lit(0.0)).alias(x), F.coalesce(y, F.lit(0.0)).alias(y))
