"""Columns derived from a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import CALENDAR, change, change_percentage
from strata.functions.columns import movement as movement_of


def price_change(df: DataFrame, prefix: str) -> DataFrame:
    c, o = F.col("close"), F.col("open")
    return df.withColumns({f"{prefix}_change": change(c, o), f"{prefix}_change_percentage": change_percentage(c, o)})


def movement(df: DataFrame) -> DataFrame:
    return df.withColumn("market_movement", movement_of(F.col("close"), F.col("open")))


def calendar(df: DataFrame, column: str, parts: tuple[str, ...]) -> DataFrame:
    return df.withColumns({p: CALENDAR[p](F.col(column)) for p in parts})
