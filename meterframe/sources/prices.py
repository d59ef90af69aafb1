"""Day-ahead prices: the relational table and the point form (SRC-6, SRC-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterframe import schemas
from meterframe.operators.pricing import a44_prices


def read_day_ahead_prices(spark: SparkSession, path: str) -> DataFrame:
    """``(time, price)`` in EUR/MWh; no filter on area or type, as in the reference."""
    return spark.read.schema(schemas.PRICES).parquet(path)


def read_price_points(spark: SparkSession, path: str) -> DataFrame:
    """Point-form prices with tags (``schemas.PRICE_POINTS``)."""
    return spark.read.schema(schemas.PRICE_POINTS).parquet(path)


def point_prices(points: DataFrame) -> DataFrame:
    """The lookup table of the wide path: type A44, first row per time."""
    return a44_prices(points)
