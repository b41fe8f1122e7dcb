"""Writers: Parquet is the silver of record, CSV is derived from it, quarantine and raw documents are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.readers import read_parquet

CSV = {"header": True, "escape": '"', "nullValue": "\\N", "emptyValue": '""', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared spark.checkpoint.dir; under /tmp only in local mode where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/strata-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, partitions: tuple[str, ...] = (), sort: tuple[str, ...] = (), mode: str = "overwrite") -> DataFrame:
    """Writes df once and returns it as read back. With partitions, overwriting replaces only those that df has.

    Rows of a partition value are brought together first, so that each makes few files; a value with very many rows is split
    by size again (adaptive execution), so no task writes it alone. sort orders rows inside files.
    """
    schema = df.schema
    if partitions:
        df = df.hint("rebalance", *(F.col(f"`{p}`") for p in partitions))
    if sort:
        df = df.sortWithinPartitions(*sort)
    writer = df.write.mode(mode)
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions) if partitions else writer).parquet(path)
    back = read_parquet(df.sparkSession, path)
    return back.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def write_dual(df: DataFrame, path: str, partitions: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> DataFrame:
    """path/format=parquet is written, and path/format=csv from it: the two can't differ, and df's plan runs once."""
    back = write_parquet(df, f"{path}/format=parquet", partitions, sort)
    write_csv(back, f"{path}/format=csv")
    return back


def write_quarantine(df: DataFrame, path: str, batch_id: str) -> None:
    """Rejected rows, by batch and reason. Other batches' stay; a batch that runs again replaces its own."""
    df.drop("batch_id").write.mode("overwrite").partitionBy("validation_reason").parquet(f"{path}/batch_id={batch_id}")


def land(documents: DataFrame, path: str, dataset: Column | str, run_date: str) -> None:
    """Raw documents as they came (key, value), under their dataset and run, in one write. A run that lands a dataset again
    replaces what it landed; other runs' stay.

    dataset: a column of documents, or one name for all. Rows with a null or new name are kept. Folder names can't tell an
    empty name from null, so the name is also in the files (dataset_name); readers.read_landed gives it back.
    """
    name = F.lit(dataset).cast("string")
    documents.select("key", "value", name.alias("dataset_name"), name.alias("dataset"), F.lit(run_date).alias("run_date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_date").parquet(path)


def compact(spark: SparkSession, path: str, target: str, rows_per_file: int = 5_000_000) -> None:
    """Many small files of a table to few, at another path."""
    df = spark.read.parquet(path)
    df.repartition(max(1, -(-df.count() // rows_per_file))).write.mode("overwrite").parquet(target)
