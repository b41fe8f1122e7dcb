"""Readers with explicit schemas, read modes, and guards against missing paths and error documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.spec import ERROR_KEYS

CORRUPT = "_corrupt_record"
#: Ends a document in a file of many: JSON text has this character only escaped, and may have newlines.
RECORD = "\x1e"


def read_json(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = "*.json", multi_line: bool = True) -> DataFrame:
    """JSON documents under path, at any depth."""
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE", corrupt: bool = False, multi_line: bool = False, **options) -> DataFrame:
    """CSV with a header. mode: PERMISSIVE, DROPMALFORMED or FAILFAST; corrupt adds the text of malformed rows (write the result
    before asking for that text alone: Spark doesn't parse rows for it only).

    Text fields are quoted when written, so that null (nothing) and the empty string ("") differ. multi_line: fields may hold
    newlines; such a file can't be split, so it is one task's.
    """
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"columnNameOfCorruptRecord": CORRUPT, **options}
    defaults = {"header": True, "multiLine": multi_line, "escape": '"', "nullValue": "\\N", "emptyValue": "", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return spark.read.schema(schema).options(**(defaults | {"mode": mode} | options)).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
    """What read() gives, or an empty frame of the schema if its path isn't there. Any other error is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_csv_located(spark: SparkSession, path: str, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of a PERMISSIVE read: rejected has what could be read of each malformed row, its text (value), its file,
    and at which byte of the file the part begins that a task read it from. Write rejected with its columns before asking
    for the text alone: Spark doesn't parse rows for it only."""
    rows = read_csv(spark, path, schema, corrupt=True, **options)
    bad = rows.select(*schema.names, F.col(CORRUPT).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part_start"))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), bad.where("value is not null")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a PERMISSIVE read with the corrupt column; bad is the texts alone."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_documents(spark: SparkSession, path: str, glob: str = "*.json", separator: str | None = None) -> DataFrame:
    """path and value (the whole text) of each document. A file is one document; with a separator, such as RECORD, it holds
    many, each ended by one, and several tasks may share it."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    reader = reader.option("lineSep", separator) if separator else reader.option("wholetext", True)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """dataset, run_date, key and value as landed; names stay text, also those that look like numbers."""
    rows = spark.read.schema("key string, value string, dataset_name string, dataset string, run_date string").parquet(path)
    return rows.select(F.col("dataset_name").alias("dataset"), "run_date", "key", "value")


def new_files(spark: SparkSession, path: str, read: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """path, modified and bytes of the files under path that aren't in read, or were written again since. Contents aren't read."""
    listing = read_or_empty(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path), T.StructType.fromDDL("path string, modificationTime timestamp, length long"))
    return listing.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).join(read, ["path", "modified", "bytes"], "left_anti")


def read_landed_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """As read_landed, of these files under path alone."""
    schema = "key string, value string, dataset_name string, dataset string, run_date string"
    rows = spark.read.schema(schema).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.select(F.col("dataset_name").alias("dataset"), "run_date", "key", "value")


def split_error_payloads(documents: DataFrame, keys: tuple[str, ...] = ERROR_KEYS) -> tuple[DataFrame, DataFrame]:
    """(data, errors) of raw documents with a column value: an error has one of the keys at its top; errors get `error`."""
    error = F.coalesce(*(F.get_json_object("value", f"$['{k}']") for k in keys))
    tagged = documents.withColumn("error", error)
    return tagged.where("error is null").drop("error"), tagged.where("error is not null")


def parse_documents(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of raw documents' JSON text."""
    return documents.select(F.from_json("value", schema).alias("d")).select("d.*")


def schema_drift(df: DataFrame, spec: T.StructType, count: bool = False) -> DataFrame:
    """column, expected, found, drift (missing, unexpected, type) for each column that differs from the spec.

    count: also n_unreadable, how many values of a column of another type can't be read as the expected one (else null).
    """
    want, have = ({f.name: f.dataType.simpleString() for f in s} for s in (spec, df.schema))
    rows = [(n, want.get(n), have.get(n), "missing" if n not in have else "unexpected" if n not in want else "type") for n in sorted({*want, *have}) if want.get(n) != have.get(n)]
    drift = df.sparkSession.createDataFrame(rows, "column string, expected string, found string, drift string")
    if not count:
        return drift
    other = [(n, t) for n, t, _, kind in rows if kind == "type"]
    bad = df.agg(*(F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast(t).isNull()).alias(f"n{i}") for i, (n, t) in enumerate(other)), F.count("*").alias("n_rows"))
    long = bad.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("n_unreadable")) for i, (n, _) in enumerate(other)))).alias("x")).select("x.*") if other else drift.select("column", F.lit(0).cast("long").alias("n_unreadable")).limit(0)
    return drift.join(F.broadcast(long), "column", "left")


def read_run(spark: SparkSession, path: str, **run: int | str) -> DataFrame:
    """The rows of one run partition, e.g. year=2001, month=8, day=2: a filter on partition columns, so others aren't listed or read."""
    return spark.read.parquet(path).where(" and ".join(f"{k} = {v!r}" for k, v in run.items())).drop(*run)
