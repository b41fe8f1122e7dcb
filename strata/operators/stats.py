"""Trailing statistics of bars, per key.

As-of statistics are the same on every row of a key: one window over the key gives all six in one pass, without a join.
A key with very many rows would sort in one task; strategy "agg" aggregates first (partial sums per task) and joins the
row per key back. Rolling statistics follow each row by date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions.columns import rounded

MEAN_DAYS, RANGE_DAYS = 30, 365


def as_of_exprs(day: str, as_of: date | str) -> dict[str, Column]:
    since = lambda days, c: F.when(F.col(day) >= F.date_sub(F.lit(str(as_of)).cast("date"), days), F.col(c))
    return {
        "thirty_day_avg_open": F.avg(since(MEAN_DAYS, "open")), "thirty_day_avg_close": F.avg(since(MEAN_DAYS, "close")),
        "fifty_two_week_high": F.max(since(RANGE_DAYS, "high")), "fifty_two_week_low": F.min(since(RANGE_DAYS, "low")),
        "all_time_high": F.max("high"), "all_time_low": F.min("low"),
    }


def as_of_summary(df: DataFrame, keys: list[str], day: str, as_of: date | str, names: list[str] | None = None) -> DataFrame:
    """A row per key with the statistics (all, or those named); null where no row is recent enough."""
    return df.groupBy(*keys).agg(*(rounded(c).alias(n) for n, c in as_of_exprs(day, as_of).items() if n in (names or [n])))


def as_of_stats(df: DataFrame, keys: list[str], day: str, as_of: date | str, strategy: str = "window") -> DataFrame:
    """The six statistics on every row. strategy: "window" or, for keys with very many rows, "agg"."""
    if strategy == "window":
        over = Window.partitionBy(*keys)
        return df.withColumns({n: rounded(c.over(over)) for n, c in as_of_exprs(day, as_of).items()})
    return df.join(as_of_summary(df, keys, day, as_of), keys, "left")


def rolling(keys: list[str], day: str, days: int):
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)


def rolling_mean(df: DataFrame, keys: list[str], day: str, days: int = MEAN_DAYS) -> DataFrame:
    over = rolling(keys, day, days)
    return df.withColumns({"rolling_avg_open": rounded(F.avg("open").over(over)), "rolling_avg_close": rounded(F.avg("close").over(over))})


def rolling_range(df: DataFrame, keys: list[str], day: str, days: int = RANGE_DAYS) -> DataFrame:
    over = rolling(keys, day, days)
    return df.withColumns({"rolling_high": rounded(F.max("high").over(over)), "rolling_low": rounded(F.min("low").over(over))})


def running_extremes(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"running_high": rounded(F.max("high").over(over)), "running_low": rounded(F.min("low").over(over))})


def history_stats(history: DataFrame, increment: DataFrame, keys: list[str], day: str, as_of: date | str, strategy: str = "window") -> DataFrame:
    """The increment's rows with statistics over history and increment; history is read for the increment's keys only.

    A row of the increment replaces one of the history with the same keys and day.
    """
    ids = [*keys, day]
    touched = history.select(*increment.columns).join(increment.select(*keys).distinct(), keys, "left_semi").join(increment.select(*ids), ids, "left_anti")
    both = touched.withColumn("__new", F.lit(False)).unionByName(increment.withColumn("__new", F.lit(True)))
    return as_of_stats(both, keys, day, as_of, strategy).where("__new").drop("__new")
