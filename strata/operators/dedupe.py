"""One row per key, chosen by an order that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order. A top-one window keeps one row per key and task before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns (nulls smallest), by keep_one."""
    return keep_one(df, keys, [F.col(f"`{c}`").desc_nulls_last() for c in order])
