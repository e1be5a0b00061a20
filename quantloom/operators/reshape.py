"""Projection, filters, calendars and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C

CANONICAL = ("Date", "Ticker", "Open", "High", "Low", "Close", "Adj Close", "Volume")


def rename_canonical(df: DataFrame) -> DataFrame:
    """Columns that equal a canonical name but for case take that name."""
    names = {c.lower(): c for c in CANONICAL}
    return df.withColumnsRenamed({c: names[c.lower()] for c in df.columns if c.lower() in names})


def drop_adjusted(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "adj" in c.lower()])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; an error if none is left."""
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if n[i]]
    if not kept:
        raise ValueError("no column holds a value")
    return df.select(*[F.col(f"`{c}`") for c in kept])


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, pos): distinct dates with their position from 1. A calendar has as many rows as there are dates."""
    return df.select(ts).where(F.col(ts).isNotNull()).distinct().withColumn("pos", F.row_number().over(Window.orderBy(ts)).cast("long"))


def reindex(df: DataFrame, dates: DataFrame, group: str = "ticker", ts: str = "ts") -> DataFrame:
    """Every group on every date, exact matches only and nothing filled.

    The groups alone are few bytes, which adaptive execution would gather in one task; a stated number of partitions keeps the
    grid that they grow into spread out, by group, as the windows over it want it.
    """
    days = dates.agg(F.array_sort(F.collect_list(F.struct(ts, "pos"))).alias("days"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = df.select(group).distinct().repartition(parts, F.col(f"`{group}`")).join(F.broadcast(days)).select(group, F.explode("days").alias("d")).select(group, "d.*")
    return grid.join(df, [group, ts], "left")


def densify(df: DataFrame, group: str = "ticker", ts: str = "ts") -> DataFrame:
    return reindex(df, calendar(df, ts), group, ts)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [c for c, k in df.dtypes if (k in kinds or k.startswith("decimal")) and c not in exclude]


def melt(df: DataFrame, ids: list[str], variable: str = "ticker", value: str = "value") -> DataFrame:
    return df.unpivot(ids, None, variable, value).where(F.col(value).isNotNull())


def pivot(df: DataFrame, index: str, columns: str, value: str, names: list[str] | None = None) -> DataFrame:
    g = df.groupBy(index)
    return (g.pivot(columns, names) if names else g.pivot(columns)).agg(F.first(value, ignorenulls=True))


def cross_section(df: DataFrame, field: str, ts: str = "ts", sep: str = "|") -> DataFrame:
    """One field of a wide two-level table, names field|ticker or ticker|field: (ts, ticker, value)."""
    long = df.unpivot([ts], None, "name", "value")
    a, b = F.split_part("name", F.lit(sep), F.lit(1)), F.split_part("name", F.lit(sep), F.lit(2))
    fields = {"open", "high", "low", "close", "volume"}
    first = any(c.split(sep)[0].lower() in fields for c in df.columns if c != ts)
    what, who = (a, b) if first else (b, a)
    return long.where(F.lower(what) == field.lower()).select(ts, who.alias("ticker"), "value").where(F.col("value").isNotNull())


def macro_columns(df: DataFrame, name: str, schema: str, ts: str = "ts") -> DataFrame:
    """The columns that a file gives to the macro matrix: its close, its only number, or all numbers."""
    numbers = [c for c in numeric_columns(df, (ts,))]
    if schema == "OHLCV":
        closes = [c for c in df.columns if c.lower() == "close"]
        return df.select(ts, F.col(closes[0]).alias(f"{name}_Close") if closes else F.col(numbers[0]).alias(name))
    if schema == "Single_Numeric":
        return df.select(ts, F.col(numbers[0]).alias(name))
    return df.select(ts, *[F.col(c).alias(f"{name}_{c}") for c in numbers])


def forward_filled(df: DataFrame, value: str, group: str = "ticker", ts: str = "ts") -> DataFrame:
    return df.withColumn(value, C.forward_fill(F.col(value), C.series(group, ts)))


def hit_name(code: Column) -> Column:
    return F.when(code == 1, "PT").when(code == 2, "SL").when(code == 3, "VERTICAL")


def hit_label(code: Column) -> Column:
    return F.when(code == 1, 1).when(code == 2, -1).when(code == 3, 0)


def class_index(label: Column, multi: bool = True) -> Column:
    """-1, 0, 1 to 0, 1, 2; in binary mode -1 and 1 to 0 and 1, and 0 to null."""
    return label + 1 if multi else F.when(label != 0, ((label + 1) / 2).cast("int"))


def collapse_by_tickers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Without groups that hold no value at all."""
    return df.join(df.groupBy(group).agg(F.count(value).alias("__n")).where("__n > 0").select(group), group, "left_semi")
