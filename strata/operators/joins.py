"""Joins with a side that is usually small: broadcast only after its bytes were measured, shuffled beyond a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that may be broadcast, as bytes_of tells them; beyond it the same join is shuffled.
BROADCAST_BYTES = 48 << 20


def bytes_of(side: DataFrame) -> int:
    """About how many bytes the rows of a materialised side take once broadcast: its values, and 32 a row."""
    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return 16 + F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, T.ArrayType):
            fixed = not isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType)
            return 24 + (8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) if fixed else F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)))
        if isinstance(kind, T.StructType):
            return sum((width(c[f.name], f.dataType) for f in kind), F.lit(16))
        return F.lit(8)

    rows = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in side.schema), F.lit(32)).cast("long")
    return side.agg(F.sum(rows)).first()[0] or 0


def joined(df: DataFrame, side: DataFrame, on: str | list[str] | Column, how: str, limit: int | None = None) -> DataFrame:
    """df joined with a side that is usually small: broadcast if it has at most `limit` bytes, else shuffled.

    side should be stored, as measuring it runs it.
    """
    return df.join(F.broadcast(side) if bytes_of(side) <= (BROADCAST_BYTES if limit is None else limit) else side, on, how)
