"""Joins of bars with reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strata.operators.joins import joined


def enrich_left(bars: DataFrame, ref: DataFrame, key: str = "symbol", drop: tuple[str, ...] = ("processed_at",), stored: bool = False) -> DataFrame:
    """Every bar with its reference row or nulls. ref must have one row per key (see dedupe.latest).

    stored: ref is read from a table, so its bytes can be measured to decide on a broadcast; else Spark's own estimate decides.
    """
    ref = ref.drop(*drop)
    return joined(bars, ref, key, "left") if stored else bars.join(ref, key, "left")


def unmatched(bars: DataFrame, ref: DataFrame, key: str = "symbol") -> DataFrame:
    return bars.join(ref, key, "left_anti")
