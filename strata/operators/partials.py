"""Statistics from mergeable partials: a block per key and month holds counts, sums and extremes of its days.

A load recomputes the blocks that its rows touch and no others, so corrections replace what they correct. As-of statistics
take all blocks, and days of the two months alone that a trailing frame cuts. Rolling and running statistics take a row per
key and day: a key has at most one such row a day, however many rows it has, so its window is bounded by the calendar.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions.columns import rounded
from strata.operators.joins import joined
from strata.operators.stats import MEAN_DAYS, RANGE_DAYS, rolling

MEANS = ("open", "close")


def partial_columns() -> dict[str, Column]:
    sums = {f"{f}_{c}": e for c in MEANS for f, e in (("n", F.count(c)), ("sum", F.sum(c)))}
    return sums | {"high": F.max("high"), "low": F.min("low")}


def merged_columns() -> dict[str, Column]:
    return {f"{f}_{c}": F.sum(f"{f}_{c}") for c in MEANS for f in ("n", "sum")} | {"high": F.max("high"), "low": F.min("low")}


def blocks(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, month (its first day), n_open, sum_open, n_close, sum_close, high, low."""
    return df.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(*(c.alias(n) for n, c in partial_columns().items()))


def merge(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials over fewer keys."""
    return partials.groupBy(*keys).agg(*(c.alias(n) for n, c in merged_columns().items()))


def cut_months(day: str, as_of: date | str) -> Column:
    """Is the day in a month that a trailing frame starts in?"""
    start = lambda n: F.date_sub(F.lit(str(as_of)).cast("date"), n)
    inside = lambda n: (F.col(day) >= F.trunc(start(n), "month")) & (F.col(day) <= F.last_day(start(n)))
    return inside(MEAN_DAYS) | inside(RANGE_DAYS)


def as_of_summary(months: DataFrame, days: DataFrame, keys: list[str], day: str, as_of: date | str) -> DataFrame:
    """As stats.as_of_summary, a row per key, from blocks and the rows of the months that cut_months names."""
    start = lambda n: F.date_sub(F.lit(str(as_of)).cast("date"), n)
    whole = lambda n: F.col("at") > F.last_day(start(n))  # noqa: E731  # months after the one that is cut
    part = lambda n: (F.col("at") >= start(n)) & (F.col("at") <= F.last_day(start(n)))
    one = days.select(*keys, F.col(day).alias("at"), F.lit(False).alias("block"), *(x for c in MEANS for x in (F.when(F.col(c).isNotNull(), 1).otherwise(0).cast("long").alias(f"n_{c}"), F.col(c).alias(f"sum_{c}"))), "high", "low")
    rows = months.select(*keys, F.col("month").alias("at"), F.lit(True).alias("block"), *(f"{f}_{c}" for c in MEANS for f in ("n", "sum")), "high", "low").unionByName(one)
    within = lambda n, c: F.when(F.when(F.col("block"), whole(n)).otherwise(part(n)), F.col(c))
    mean = lambda c: F.try_divide(F.sum(within(MEAN_DAYS, f"sum_{c}")), F.sum(within(MEAN_DAYS, f"n_{c}")))
    every = lambda c: F.when(F.col("block"), F.col(c))
    return rows.groupBy(*keys).agg(
        rounded(mean("open")).alias("thirty_day_avg_open"), rounded(mean("close")).alias("thirty_day_avg_close"),
        rounded(F.max(within(RANGE_DAYS, "high"))).alias("fifty_two_week_high"), rounded(F.min(within(RANGE_DAYS, "low"))).alias("fifty_two_week_low"),
        rounded(F.max(every("high"))).alias("all_time_high"), rounded(F.min(every("low"))).alias("all_time_low"),
    )


def by_day(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """A row per key and day: n and the partials of its rows, combined in each task before they are shuffled."""
    return df.groupBy(*keys, day).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in partial_columns().items()))


def trailing(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Rolling means and ranges and running extremes of each key and day, from by_day's rows."""
    mean, range_, ever = rolling(keys, day, MEAN_DAYS), rolling(keys, day, RANGE_DAYS), Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, 0)
    average = lambda c: F.try_divide(F.sum(f"sum_{c}").over(mean), F.sum(f"n_{c}").over(mean))
    return days.select(
        *keys, day, "n", rounded(average("open")).alias("rolling_avg_open"), rounded(average("close")).alias("rolling_avg_close"),
        rounded(F.max("high").over(range_)).alias("rolling_high"), rounded(F.min("low").over(range_)).alias("rolling_low"),
        rounded(F.max("high").over(ever)).alias("running_high"), rounded(F.min("low").over(ever)).alias("running_low"),
    )


#: Rows of one key and day that are joined in one task.
TOGETHER = 1 << 17


def attach(df: DataFrame, by_days: DataFrame, keys: list[str], day: str, limit: int | None = None) -> DataFrame:
    """df with the columns of its key's and day's row (by_days: stored, with n, how many rows of df it stands for).

    Broadcast if that is small; else shuffled, where the rows of a key and day with very many are dealt over several tasks,
    to each of which their one row is copied. Rows with a null key or day get nulls.
    """
    ids = [*keys, day]
    hot = by_days.where(F.col("n") > TOGETHER).select(*ids, F.ceil(F.col("n") / TOGETHER).alias("deals"))
    spread = df.withColumn("__place", F.monotonically_increasing_id())
    spread = joined(spread, hot, ids, "left", limit).withColumn("__deal", F.pmod(F.xxhash64("__place"), F.coalesce("deals", F.lit(1).cast("long")))).drop("deals", "__place")
    copies = by_days.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / TOGETHER) - 1))).drop("n")
    return joined(spread, copies, [*ids, "__deal"], "left", limit).drop("__deal")
