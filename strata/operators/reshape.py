"""Nested documents to rows: explode maps and arrays, project paths, rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path(*names: str) -> Column:
    """A nested field whose names may hold dots and spaces."""
    return F.col(".".join(f"`{n}`" for n in names))


def explode_map(df: DataFrame, column: str, key: str, value: str, keep: dict[str, Column] | None = None, after: str | None = None, outer: bool = False) -> DataFrame:
    """A row per map entry: keep's columns, key, value. A null or empty map gives no row, or one of nulls if outer.

    after: only entries whose trimmed key is larger (dates as yyyy-MM-dd compare as strings). Entries are dropped inside
    the map, before rows are made: the optimizer leaves a filter above an explode.
    """
    entries = F.col(f"`{column}`")
    if after is not None:
        entries = F.map_filter(entries, lambda k, _: F.trim(k) > after)
    make = F.explode_outer if outer else F.explode
    return df.select(*(c.alias(n) for n, c in (keep or {n: F.col(f"`{n}`") for n in df.columns if n != column}).items()), make(entries).alias(key, value))


def explode_array(df: DataFrame, column: str, item: str, outer: bool = False) -> DataFrame:
    """A row per array item, with the other columns; a null or empty array gives no row, or one of nulls if outer."""
    return df.select(*(F.col(f"`{n}`") for n in df.columns if n != column), (F.explode_outer if outer else F.explode)(f"`{column}`").alias(item))


def project(df: DataFrame, outputs: dict[str, str | Column | tuple[str, ...]]) -> DataFrame:
    """Output name -> column name, nested path (a tuple of names) or expression, in this order."""
    return df.select(*((c if isinstance(c, Column) else path(*((c,) if isinstance(c, str) else c))).alias(n) for n, c in outputs.items()))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames those columns that are there, in one projection."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def bars_of(df: DataFrame, series: str, date: str, fields: dict[str, str], after: str | None = None) -> DataFrame:
    """A series document to one row per date: symbol, last_refreshed, date and the price fields, all strings."""
    rows = explode_map(df, series, date, "bar", {"symbol": path("Meta Data", "2. Symbol"), "last_refreshed": path("Meta Data", "3. Last Refreshed")}, after)
    return rows.select("symbol", "last_refreshed", date, *(path("bar", f).alias(n) for f, n in fields.items()))
