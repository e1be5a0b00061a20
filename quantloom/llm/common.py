"""Helpers shared by the corpus operators."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset (unit tests, one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quantloom-"))
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage at a place that outlives lost executors, and it fixes row order
    and contents, so that later stages that run again see the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_rows(df: DataFrame, number: str) -> DataFrame:
    """``saved`` with a number for each row in the column ``number``.

    The number is written with the row. Put on after reading, it would follow the file splits, which follow the
    executors at hand, and two scans of one query could disagree.
    """
    return saved(df.withColumn(number, F.monotonically_increasing_id()))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table that the JVM makes by itself; ``createDataFrame`` would start Python workers for them."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def content(df: DataFrame) -> tuple:
    """Two columns (hashes of 64 bits each) that tell rows apart by all they hold; maps and variants have no hash and do not count."""
    columns = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    parts = [p for c in columns for p in (c.isNull(), c)]  # a null alone would leave no trace
    return F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *parts)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that no later stage reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


HOT, MOST_HOT = 50_000, 1000


def hot_from(total: int) -> int:
    """The least number of rows of a key that is treated as hot: more than ``HOT`` and more than a thousandth of all."""
    return max(HOT, total // MOST_HOT)


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``table`` for their ``key``; ``n`` is a column with how many rows the key has, ``total`` all rows.

    Rows of hot keys do not meet in one task: fewer than ``MOST_HOT`` keys can be hot, so their part of ``table`` is broadcast.
    """
    if total <= HOT:  # no key can be hot
        return rows.join(table.drop(n), key)
    hot = F.broadcast(table.where(F.col(n) > hot_from(total)).drop(n))
    cold = table.where(F.col(n) <= hot_from(total)).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def cells_for(rows: int, per_cell: int = 100_000, least: int = 64, most: int = 65_536) -> int:
    """Number of salts that keeps a third of all rows in cells of ``per_cell`` rows or fewer."""
    return max(least, min(most, -(-rows // per_cell)))


def with_rank(df: DataFrame, group: list[str], cells: int, tie: str, order: list | None = None) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... without gaps inside each group, balanced however large a group is.

    ``tie`` is a long that is stored with each row: its number, or a hash of all that it holds (equal rows then share it). Salts and ranks
    follow from it alone, so they do not depend on how a table is split or on which executors read it; copies of a
    row and null keys spread as well. ``order`` (columns of low cardinality in a group) puts the cells of a group in that order.
    """
    from pyspark.sql import Window

    order = order or []
    at = df.withColumn("__cell", F.pmod(F.xxhash64(F.col(tie)), F.lit(cells)))
    # A null-safe key, so that the join below keeps rows with null keys.
    at = at.withColumn("__key", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in group + order] or [F.lit(0)]))
    counts = at.groupBy("__key", "__cell", *group, *order).agg(F.count(F.lit(1)).alias("__n"))
    level = counts.groupBy("__key", *group, *order).agg(F.sum("__n").alias("__n"))
    if order:
        before = F.sum("__n").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        level = level.withColumn("__base", F.coalesce(before, F.lit(0)))
    else:
        level = level.withColumn("__base", F.lit(0).cast("long"))
    inside = F.sum("__n").over(Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("__key", "__cell", F.coalesce(inside, F.lit(0)).alias("__in"))
    first = first.join(level.select("__key", "__base"), "__key").select("__key", "__cell", (F.col("__in") + F.col("__base")).alias("__first"))
    nth = F.row_number().over(Window.partitionBy("__key", "__cell").orderBy(tie))
    return (
        at.withColumn("__nth", nth)
        .join(first, ["__key", "__cell"])
        .withColumn("rank", F.col("__nth") - 1 + F.col("__first"))
        .drop("__cell", "__key", "__nth", "__first")
    )
