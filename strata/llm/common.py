"""What the operators of this subpackage share: inputs, shared scratch tables, Arrow batches, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.joins import bytes_of
from strata.sources.sinks import scratch

#: Bytes of a side that may be broadcast, as bytes_of tells them; beyond it the same join is shuffled.
BROADCAST_BYTES = 48 << 20
#: Rows and bytes of an Arrow batch: whole texts can be long, and a Python worker holds one batch at a time.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str, chunk: int = 4096) -> DataFrame:
    """Runs make() once per task; the function it returns takes a batch as {column: list} and yields output rows as tuples.

    Rows leave in chunks, so a task holds one input batch and one output chunk.
    """
    small_batches(df.sparkSession)
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches):
        handle = make()
        for batch in batches:
            rows = []
            for row in handle(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))):
                rows.append(row)
                if len(rows) >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str) -> DataFrame:
    """As map_rows, but the function yields tuples of whole columns (numpy or Arrow arrays): for many small rows."""
    small_batches(df.sparkSession)
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches):
        handle = make()
        for batch in batches:
            for columns in handle(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))):
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def joined(df: DataFrame, side: DataFrame, on: str | list[str] | Column, how: str, limit: int | None = None) -> DataFrame:
    """df joined with a side that is usually small: broadcast if it has at most `limit` bytes, else shuffled.

    side should be materialised, as measuring it runs it.
    """
    return df.join(F.broadcast(side) if bytes_of(side) <= (BROADCAST_BYTES if limit is None else limit) else side, on, how)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that other columns of whatever name can't clash."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def part_of(text: str) -> Column:
    """A hash of the text (null: empty), which tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def parted(docs: DataFrame) -> DataFrame:
    """doc_id, part and text of the rows that have an id."""
    return texts(docs).where("doc_id is not null").withColumn("part", part_of("text"))


def words_ascii(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
