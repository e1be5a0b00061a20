"""Cross-validation without leaks: purged folds with embargo, and expanding splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_table(labels: DataFrame, splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """(fold, start, end, embargo_end): equal runs of the distinct event dates; one row for each fold."""
    dates = labels.select("ts").where("ts IS NOT NULL").distinct()
    w = Window.orderBy("ts")  # distinct dates only
    placed = dates.select("ts", F.ntile(splits).over(w).alias("fold"), F.row_number().over(w).alias("i"))
    n = placed.agg(F.max("i").alias("n"))
    g = placed.groupBy("fold").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("i").alias("i")).join(F.broadcast(n))
    g = g.withColumn("j", F.least(F.col("n"), F.col("i") + F.floor(F.col("n") * embargo)))
    return g.join(placed.select(F.col("i").alias("j"), F.col("ts").alias("embargo_end")), "j").select("fold", "start", "end", "embargo_end")


def purged_folds(labels: DataFrame, splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """(label_index, fold, split): a label trains for a fold unless it is tested there, overlaps the test span, or starts in the embargo."""
    folds = fold_table(labels, splits, embargo)  # `splits` rows
    every = labels.where("ts IS NOT NULL AND exit_ts IS NOT NULL").join(F.broadcast(folds))
    t, x = F.col("ts"), F.col("exit_ts")
    test = t.between(F.col("start"), F.col("end"))
    purge = (t <= F.col("end")) & (x >= F.col("start"))
    held = (t > F.col("end")) & (t <= F.col("embargo_end"))
    split = F.when(test, "Test").when(~(purge | held), "Train")
    return every.select("label_index", "fold", split.alias("split")).where("split IS NOT NULL")


def expanding_splits(n: int, splits: int = 5, least: int = 252, test: int = 63) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, test_start, test_end): positions; training starts at 0 and grows up to each test run."""
    first = n - splits * test
    if first < least:
        raise ValueError("not enough observations")
    return [(k + 1, first + k * test, first + k * test, first + (k + 1) * test) for k in range(splits)]
