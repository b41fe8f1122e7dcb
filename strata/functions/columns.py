"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.spec import NULL_TOKENS

DATE_PATTERN = "yyyy-MM-dd"


def null_if_token(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*tokens), c)


def typed(c: Column, kind: str, pattern: str = DATE_PATTERN) -> Column:
    """c as another type; what can't be read becomes null instead of an error."""
    return F.try_to_date(c, pattern) if kind == "date" else c.try_cast(kind)


def rounded(c: Column, scale: int = 2) -> Column:
    """Half-up rounding of the decimal value, so that sums in another order round alike; beyond decimals, plain rounding."""
    return F.coalesce(F.round(c.try_cast("decimal(28,8)"), scale).cast("double"), F.round(c, scale))


def change(close: Column, open_: Column) -> Column:
    return rounded(close - open_)


def change_percentage(close: Column, open_: Column) -> Column:
    """Null for an open price of zero."""
    return rounded(F.try_divide(close - open_, open_) * 100)


def movement(close: Column, open_: Column) -> Column:
    return F.when(close > open_, "Bull").when(close < open_, "Bear").otherwise("Neutral")


#: week_number is the ISO week, year the calendar year: 2021-01-01 has year 2021 and week 53.
CALENDAR = {"year": F.year, "month": F.month, "day": F.dayofmonth, "week_number": F.weekofyear}


def canonical(names: list[str]) -> Column:
    """A row's text for hashing: fields in the order of names, null apart from empty, separators escaped."""
    def one(n: str) -> Column:
        text = F.replace(F.replace(F.col(f"`{n}`").cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("|", *map(one, names))
