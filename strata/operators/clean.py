"""Cleaning: trimming, tokens that mean null, tolerant typing, defaults, rounding, run columns. One projection each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import null_if_token, rounded, typed
from strata.spec import NULL_TOKENS


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def trim_cols(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(f"`{c}`")) for c in cols or strings(df)})


def upper_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.upper(F.col(f"`{c}`")) for c in cols})


def null_tokens(df: DataFrame, cols: list[str] | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: null_if_token(F.col(f"`{c}`"), tokens) for c in cols or strings(df)})


def cast_by_spec(df: DataFrame, types: dict[str, str], pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Columns as the types of the spec (those that are there); unreadable values become null."""
    return df.select(*(typed(F.col(f"`{c}`"), types[c], pattern).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))


def impute(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in defaults.items() if c in df.columns})


def round_cols(df: DataFrame, cols: list[str], scale: int = 2) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), scale) for c in cols})


def stamp(df: DataFrame, run_ts: datetime | str, batch_id: str | None = None, parts: bool = True, zone: str | None = None) -> DataFrame:
    """processed_at (the instant, in UTC), with parts the run's year, month and day; zone adds processed_local for display."""
    at = F.lit(str(run_ts)).cast("timestamp")
    cols = {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)} if parts else {}
    cols |= {"processed_at": at} | ({"batch_id": F.lit(batch_id)} if batch_id else {})
    return df.withColumns(cols | ({"processed_local": F.from_utc_timestamp(at, zone)} if zone else {}))


def clean_strings(df: DataFrame, upper: list[str]) -> DataFrame:
    """Trim every string, upper-case the keys, null the tokens: one projection."""
    def one(c: str):
        s = F.trim(F.col(f"`{c}`"))
        return null_if_token(F.upper(s) if c in upper else s)

    return df.withColumns({c: one(c) for c in strings(df)})
