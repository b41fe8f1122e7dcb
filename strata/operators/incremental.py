"""Incremental loads: append-only state, high-water marks per key, content hashes, snapshot differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import canonical
from strata.spec import STATE_SCHEMA

ID = ("pipeline_name", "dataset_name", "watermark_key")


def latest_state(state: DataFrame, by: tuple[str, ...] = ID, order: tuple[str, ...] = ("updated_at", "batch_id")) -> DataFrame:
    """The newest SUCCESS record of each key, by the columns of order; records are only ever appended."""
    rest = [c for c in state.columns if c not in by]
    row = F.struct(*order, *(c for c in rest if c not in order))
    best = state.where("status = 'SUCCESS'").groupBy(*by).agg(F.max(row).alias("__row"))
    return best.select(*by, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*state.columns)


def after_mark(df: DataFrame, marks: DataFrame, keys: list[str], day: str, lateness: int = 0) -> DataFrame:
    """Rows past their key's mark (column `mark`); keys without one are new and all theirs are kept.

    lateness: days before the mark that are read again, for late rows and corrections; 0 means strictly later rows.
    """
    known = df.join(marks.select(*keys, "mark"), keys, "left")
    return known.where(F.col("mark").isNull() | (F.col(day) > F.date_sub("mark", lateness))).drop("mark")


def is_empty(df: DataFrame) -> bool:
    """Has df no row? Tasks stop at the first one that is found."""
    return df.limit(1).count() == 0


def new_marks(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """The largest date of each key, or of all rows if there are no keys."""
    return df.groupBy(*keys).agg(F.max(day).alias("mark"))


def state_rows(marks: DataFrame, pipeline: str, dataset: str, column: str, key: str, batch_id: str, run_ts: datetime | str, content_hash: str | None = None) -> DataFrame:
    """State records to append, one per key of marks."""
    at = F.lit(str(run_ts)).cast("timestamp")
    values = {
        "pipeline_name": F.lit(pipeline), "dataset_name": F.lit(dataset), "watermark_column": F.lit(column), "watermark_key": F.col(key) if key else F.lit(None).cast("string"),
        "watermark_value": F.col("mark").cast("string"), "last_processed_at": at, "batch_id": F.lit(batch_id), "status": F.lit("SUCCESS"), "updated_at": at,
        "content_hash": F.lit(content_hash).cast("string"),
    }
    return marks.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in STATE_SCHEMA))


def row_hashes(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.sha2(canonical(sorted(c for c in df.columns if c not in exclude)), 256).alias("h"))


def content_hash(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row, content_hash: a digest of the rows, whatever their order and partitions; repeated rows count.

    It is the SHA-256 of the row count and of sums over the rows' SHA-256, taken as four numbers of 60 bits. Sums merge,
    so tasks send five numbers each, and no list of rows is made.
    """
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = row_hashes(df, exclude).agg(F.count("*").cast("decimal(38,0)").alias("s"), *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)))
    return sums.select(F.sha2(F.concat_ws(",", *(F.col(c).cast("string") for c in sums.columns)), 256).alias("content_hash"))


def hash_changed(df: DataFrame, state: DataFrame, dataset: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row: content_hash, previous_hash (null: never loaded) and changed."""
    before = latest_state(state).where(F.col("dataset_name") == dataset).select(F.col("content_hash").alias("previous_hash"))
    both = content_hash(df, exclude).unionByName(before, allowMissingColumns=True).agg(F.max("content_hash").alias("content_hash"), F.max("previous_hash").alias("previous_hash"))
    return both.withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("previous_hash")))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """keys and change: new, changed, unchanged or removed; keys are unique in either snapshot."""
    cols = sorted(c for c in new.columns if c not in (*keys, *exclude))
    side = lambda df, name: df.select(*keys, F.sha2(canonical(cols), 256).alias(name))
    both = side(old, "was").join(side(new, "now"), keys, "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def key_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def bucket_digests(df: DataFrame, keys: list[str], buckets: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """bucket and digest of the rows of each key bucket: counts and sums over row hashes, as content_hash has, to be stored
    with a snapshot."""
    hashed = df.select(key_bucket(keys, buckets), F.sha2(canonical(sorted(c for c in df.columns if c not in exclude)), 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = hashed.groupBy("bucket").agg(F.count("*").cast("decimal(38,0)").alias("s"), *(F.sum(part(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)))
    return sums.select("bucket", F.concat_ws(",", *(F.col(c).cast("string") for c in sums.columns[1:])).alias("digest"))


def diff_by_digests(old: DataFrame, new: DataFrame, old_digests: DataFrame, new_digests: DataFrame, keys: list[str], buckets: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """As snapshot_diff, but rows of buckets with equal digests are not shuffled: they are unchanged. digests: stored ones, of
    the same columns and number of buckets, a row a bucket; the changed ones are listed on the driver."""
    both = old_digests.withColumnRenamed("digest", "was").join(new_digests.withColumnRenamed("digest", "now"), "bucket", "full")
    changed = [r["bucket"] for r in both.where(~F.col("was").eqNullSafe(F.col("now"))).select("bucket").collect()]
    moved = key_bucket(keys, buckets).isin(changed) if changed else F.lit(False)
    still = new.where(~moved).select(*keys, F.lit("unchanged").alias("change"))
    return still.unionByName(snapshot_diff(old.where(moved), new.where(moved), keys, exclude)) if changed else still


def run_tally(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))
