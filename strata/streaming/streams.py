"""Streams over files; a checkpoint remembers what was read, and each run takes what is new."""

from __future__ import annotations

from collections.abc import Callable

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import dedupe
from strata.sources.readers import read_or_empty
from strata.spec import struct


def stream_apply(source: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs the batch transform on each micro-batch of what is new, gives its result to sink(df, batch_id), then ends.

    A batch that fails is given again under the same id: a sink that overwrites what that id wrote writes it once. The
    transform sees one micro-batch, so what holds over all of them (one row per key) is for the reader: see newest. With
    mode "update" a batch has the changed rows of an aggregate, and its state goes once the watermark has passed.
    """
    query = source.writeStream.outputMode(mode).foreachBatch(lambda df, n: sink(transform(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink: a micro-batch's rows in a folder of its own, which a batch that runs again overwrites."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that by_batch wrote, those of each key's last micro-batch: updates replace what was there."""
    return dedupe.latest(rows, keys, ["batch"]).drop("batch")


def tumbling_bars(ticks: DataFrame, ts: str, key: str, price: str, order: str, width: str = "1 day", lateness: str | None = "1 day") -> DataFrame:
    """open, high, low, close and volume of each key and window; ticks later than lateness are dropped in append and update mode.

    order: a column that grows with time and is unique, so that first and last are defined. Works on batches too.
    """
    at = ticks.withColumn(ts, F.col(ts).cast("timestamp"))
    if lateness and ticks.isStreaming:
        at = at.withWatermark(ts, lateness)
    bars = at.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("symbol")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def tick_partials(ticks: DataFrame, ts: str, key: str, price: str, order: str, width: str = "1 hour") -> DataFrame:
    """Bars that can be merged: those of tumbling_bars, and first_at and last_at, the smallest and largest order in each."""
    bars = ticks.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w"), F.col(key).alias("symbol")).agg(
        F.min(order).alias("first_at"), F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.max(order).alias("last_at"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_start"), "first_at", "open", "high", "low", "close", "last_at", "volume")


def roll_up(partials: DataFrame, width: str) -> DataFrame:
    """Mergeable bars of a larger width, or of the same one where several stand for a window."""
    bars = partials.groupBy("symbol", F.window("bar_start", width).alias("w")).agg(
        F.min_by("open", "first_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_at").alias("close"), F.sum("volume").alias("volume"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_start"), "first_at", "open", "high", "low", "close", "last_at", "volume")


def ticks_sink(path: str, ts: str, key: str, price: str, order: str, width: str = "1 hour", lateness: str = "1 day") -> Callable[[DataFrame, int], None]:
    """A sink of ticks: path/bars has mergeable bars of those on time, path/late the others as they came, path/marks a row a batch
    (batch, newest, n_on_time, n_late). A tick is late if it lies `lateness` or more behind the newest of the batches before, or
    has no time; so none is lost, and a batch that runs again divides its ticks as it did."""
    marks_schema = struct(batch="bigint", newest="timestamp", n_on_time="bigint", n_late="bigint")

    def sink(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        marks = read_or_empty(spark, lambda: spark.read.schema(marks_schema).parquet(f"{path}/marks"), marks_schema)
        newest = marks.where(F.col("batch") < n).agg(F.max("newest")).first()[0]
        at = F.col(ts).cast("timestamp")
        late = at.isNull() if newest is None else F.coalesce(at < F.lit(newest) - F.expr(f"interval {lateness}"), F.lit(True))
        df.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={n}")
        tick_partials(df.where(~late), ts, key, price, order, width).write.mode("overwrite").parquet(f"{path}/bars/batch={n}")
        row = df.agg(F.max(at).alias("newest"), F.count_if(~late).alias("n_on_time"), F.count_if(late).alias("n_late"))
        row.select(F.lit(n).cast("bigint").alias("batch"), "newest", "n_on_time", "n_late").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/of={n}")

    return sink


class KeyedTable:
    """A table with one row a key, rewritten bucket by bucket: a batch reads and writes the buckets that its rows fall in, and a
    manifest names the version of each bucket that readers take. No reader has to deduplicate.

    keys, order: the first row of a key in this order stays. bucket: an expression of the keys alone, such as a month of a date
    in them, so that batches of recent rows touch few buckets; a null is a bucket too. A batch that runs again reads what it
    read the first time, and replaces what it wrote; one that ends before its manifest isn't seen.
    """

    MANIFEST = struct("bucket", version="bigint")

    def __init__(self, path: str, schema: T.StructType, keys: list[str], order: list[Column], bucket: Column):
        self.path, self.schema, self.keys, self.order, self.bucket = path, schema, keys, order, F.coalesce(bucket.cast("string"), F.lit("none"))

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[str, int]:
        """Bucket -> version, of batches before the one given: a row a bucket."""
        rows = read_or_empty(spark, lambda: spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest"), self.MANIFEST)
        rows = rows if before is None else rows.where(F.col("version") < before)
        return {r["bucket"]: r["version"] for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def files(self, spark: SparkSession, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={quote(b)}" for b, v in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, n: int) -> None:
        """Adds the rows of batch n (a sink of stream_apply)."""
        spark = rows.sparkSession
        rows = rows.select(*self.schema.names).withColumn("__bucket", self.bucket)
        touched = {r[0] for r in rows.select("__bucket").distinct().collect()}
        if not touched:
            return
        known = {b: v for b, v in self.manifest(spark, n).items() if b in touched}
        stored = self.files(spark, known).withColumn("__bucket", self.bucket)
        one = dedupe.keep_one(stored.unionByName(rows), self.keys, self.order).withColumnRenamed("__bucket", "bucket")
        one.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={n}")
        made = spark.createDataFrame([(b, n) for b in sorted(touched)], self.MANIFEST)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.files(spark, self.manifest(spark))


def dedupe_within(events: DataFrame, keys: list[str], ts: str, lateness: str = "1 day") -> DataFrame:
    """The first of events with equal keys that come within lateness of each other; state is dropped after that."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
