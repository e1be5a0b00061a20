"""Cutting long plans at a table that all executors can read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(df: DataFrame) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; on one machine without it a temporary one."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quantloom-")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint in ``spark.checkpoint.dir``; a folder of its own only where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
    return df.checkpoint()


_WRITTEN: dict[tuple, str] = {}


def once(key: tuple, spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, written at its first use in an application and read again as long as it is there.

    Queries over one chain of models share its steps in this way. The key names all that the table depends on.
    """
    at = (spark.sparkContext.applicationId, *key)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def complete(p: str) -> bool:
        path = hadoop.Path(p, "_SUCCESS")
        return path.getFileSystem(conf).exists(path)

    if at not in _WRITTEN or not complete(_WRITTEN[at]):
        df = build()
        path = folder(df)
        df.write.parquet(path)
        _WRITTEN[at] = path
    return spark.read.parquet(_WRITTEN[at])


def forget() -> None:
    """Have the tables of ``once`` made anew, as a benchmark wants."""
    _WRITTEN.clear()
