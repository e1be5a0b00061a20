"""File sources and sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All Parquet files below a folder, with the stem of each file as ``dataset``."""
    r = spark.read.option("recursiveFileLookup", True)
    df = (r.schema(schema) if schema else r.option("mergeSchema", True)).parquet(path)
    return df.withColumn("dataset", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the paths that exists, names in lower case. A file that is there and cannot be read is an error."""
    if not paths:
        raise ValueError("no path")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        path = hadoop.Path(p)
        return path.getFileSystem(conf).exists(path)

    df = spark.read.csv(next((p for p in paths if exists(p)), paths[-1]), header=True)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_batched(spark: SparkSession, paths: list[str], ts: str = "Date", sep: str = "|") -> DataFrame:
    """Wide files of batches of symbols (columns symbol|field beside the date) as one long table (ticker, ts, open, high, low, close, volume).

    Symbols and days without any value go, as failed downloads leave them.
    """
    parts = []
    for path in paths:
        wide = spark.read.csv(path, header=True)
        long = wide.unpivot([ts], None, "name", "value").where("value IS NOT NULL")
        parts.append(long.select(F.split_part("name", F.lit(sep), F.lit(1)).alias("ticker"), F.to_date(ts).alias("ts"), F.lower(F.split_part("name", F.lit(sep), F.lit(2))).alias("field"), F.col("value").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fields = ["open", "high", "low", "close", "volume"]
    return out.groupBy("ticker", "ts").pivot("field", fields).agg(F.first("value")).select("ticker", "ts", *fields)


def write_batches(bars: DataFrame, path: str, size: int = 50, ts: str = "Date", sep: str = "|") -> list[str]:
    """Long bars (ticker, ts, o, h, l, c, v) as wide CSV folders of ``size`` symbols each, as batched downloads land."""
    names = [r["ticker"] for r in bars.select("ticker").distinct().orderBy("ticker").collect()]
    fields, out = {"o": "Open", "h": "High", "l": "Low", "c": "Close", "v": "Volume"}, []
    for k in range(0, len(names), size):
        batch = names[k : k + size]
        wide = bars.where(F.col("ticker").isin(batch)).groupBy(F.col("ts").alias(ts)).pivot("ticker", batch).agg(*[F.first(c).alias(n) for c, n in fields.items()])
        out.append(f"{path}/batch_{k // size:05}")
        write_csv(wide.toDF(ts, *[f"{t}{sep}{n}" for t in batch for n in fields.values()]), out[-1])
    return out


def constituents(df: DataFrame) -> DataFrame:
    """(symbol, sector, industry) from membership tables with either set of names."""
    from quantloom.functions.columns import symbol

    pick = lambda *names: next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))
    return df.select(symbol(pick("symbol", "ticker")).alias("symbol"), pick("sector", "gics sector").alias("sector"), pick("industry", "gics sub-industry").alias("industry")).where("symbol IS NOT NULL")


def with_retries(call: Callable[[], DataFrame], attempts: int = 3, pause: float = 1.5) -> DataFrame:
    """For connectors outside Spark; inside, tasks are retried by the scheduler."""
    for k in range(attempts):
        try:
            return call()
        except OSError:
            if k + 1 == attempts:
                raise
            time.sleep(pause)
    raise ValueError("no attempt")


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(found: DataFrame, path: str) -> None:
    """Rule violations (rule, n, examples) as text, one block for each rule."""
    line = F.concat_ws("\n", F.concat(F.lit("["), "rule", F.lit("] "), F.col("n").cast("string")), F.concat(F.lit("  e.g. "), "examples"))
    found.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
