"""Data quality: ordered rules, a kept quarantine, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.spec import Rule


def tag(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """validation_reason, the first rule that holds (null: none), and validation_status, which follows from it."""
    reason = F.coalesce(*(F.when(bad, F.lit(text)) for text, bad in rules))
    return df.withColumn("validation_reason", reason).withColumn("validation_status", F.when(F.col("validation_reason").isNull(), "VALID").otherwise("INVALID"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of tagged rows; together they are the input."""
    return df.where("validation_status = 'VALID'"), df.where("validation_status = 'INVALID'")


def observed_counts(df: DataFrame, name: str = "quality") -> tuple[DataFrame, Observation]:
    """df with counts of all, valid and invalid rows taken along as it is written: no pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("n_rows"), F.count_if(F.col("validation_status") == "VALID").alias("n_valid"), F.count_if(F.col("validation_status") == "INVALID").alias("n_invalid")), seen


def counts(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_valid, n_invalid."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("validation_status") == "VALID").alias("n_valid"), F.count_if(F.col("validation_status") == "INVALID").alias("n_invalid"))


def reason_counts(df: DataFrame) -> DataFrame:
    """validation_reason, n and its share of all rows, in percent with two places."""
    by_reason = df.groupBy("validation_reason").agg(F.count("*").alias("n"))  # a row per rule, and one for valid rows
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    share = F.round((F.col("n") * 100).cast("decimal(28,8)") / total, 2).cast("double")
    return by_reason.withColumn("share", share).where("validation_reason is not null")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
