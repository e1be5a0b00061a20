"""Panels of bars over the star-schema tables: (ticker, ts, o, h, l, c, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import aggregates as A
from quantloom.operators import reshape as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order() -> Column:
    return F.weekday("l_shipdate") * F.lit(10**17) + F.col("l_orderkey") * F.lit(10**5) + F.col("l_linenumber") * F.lit(10**4) + F.col("l_partkey") % 10_000


def ticks_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of line items by brand; the optimiser broadcasts ``part`` where it is small.

    Inside a week ticks are ordered by day, order, line and part. One long holds that order, which lets bars be
    aggregated by hash; a struct would have Spark sort all ticks first.
    """
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "ticker", F.to_date(F.date_trunc("week", "l_shipdate")).alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"), _order().alias("ord")
    )


def bars_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars as wide as there are parts: a ticker for each of them."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    part = table(spark, sf_dir, "part").select("p_partkey")
    ticks = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"), _order().alias("ord")
    )
    return A.bars_from_ticks(ticks)


def bars_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bars_from_ticks(ticks_w(spark, sf_dir))


def panel_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars on the dense calendar, with the position of each date."""
    return R.densify(bars_w(spark, sf_dir))


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order values by market segment; dates have gaps."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"))
    ticks = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "ticker", F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("px"), F.lit(1.0).alias("q"), F.col("o_orderkey").alias("ord")
    )
    return A.bars_from_ticks(ticks)


def ticks_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by type; ``at`` is the instant."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").alias("at"), F.col("value").alias("px"), F.lit(1.0).alias("q"), F.struct("ts", "event_id").alias("ord")
    )


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bars_from_ticks(ticks_h(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "at")))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by priority: (ts, feature, value)."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("ts"), F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("feature")).agg(
        (F.sum((F.col("o_totalprice") * 100).cast("decimal(20,0)")) / 100).cast("double").alias("value")
    )
