"""Registered queries over panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import domain, relations, windows
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, features and volatility in one plan."""
    return QUERIES["feature_panel"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "domain", "flagship", "relations", "windows"]
