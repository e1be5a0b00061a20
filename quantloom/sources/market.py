"""A Python data source for market series that another process has landed as files.

The engine opens no network connection. ``format("landed_market")`` with option ``path`` and ``symbols`` gives one
partition for each symbol; for each the first landed file of its candidates is read.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ticker string, ts string, open double, high double, low double, close double, volume double"


class _Symbol(InputPartition):
    def __init__(self, value: str):
        self.value = value


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.symbols = options["path"], [s for s in options.get("symbols", "").split(",") if s]

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = partition.value.split("|")  # candidates, the first is the name of the series
        found = next((f for n in names if os.path.exists(f := os.path.join(self.path, f"{n}.csv"))), None)
        if found is None:
            return
        with open(found, newline="") as f:
            for row in csv.DictReader(f):
                low = {k.lower(): v for k, v in row.items()}
                num = lambda k: float(low[k]) if low.get(k) not in (None, "") else None  # noqa: B023, E731
                yield (names[0], low.get("date"), num("open"), num("high"), num("low"), num("close"), num("volume"))


class LandedMarket(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_market"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedMarket)
