"""Batches that may be repeated: each try of a batch writes beside the others, and a commit record says which one readers take.

A try that ends before its commit is never seen. A batch keeps the place in the order of batches that its first commit got,
so that repeating it sees the state of the batches before it, and rows of later batches still win over its own. One writer
at a time is assumed, as two could take the same place.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.readers import read_or_empty
from strata.spec import struct

METRICS = dict(n_rows="bigint", n_valid="bigint", n_invalid="bigint", n_written="bigint", old_mark="date", new_mark="date", skipped="boolean")
LOG = struct("batch_id", **METRICS)
RECORD = struct(seq="bigint", number="bigint", version="bigint", batch_id="string", attempt="string", parts=T.ArrayType(T.StringType()), **METRICS)


@dataclass(frozen=True)
class Attempt:
    """One try of a batch: seq is the batch's place, number counts its tries, version those of all batches."""

    root: str
    dataset: str
    batch_id: str
    seq: int
    number: int
    version: int
    attempt: str
    #: The records that counted when it began.
    known: tuple[Row, ...]

    def path(self, part: str) -> str:
        return path_of(self.root, self.dataset, part, self.batch_id, self.attempt)


def path_of(root: str, dataset: str, part: str, batch_id: str, attempt: str) -> str:
    return f"{root}/{part}/{dataset}/batch={quote(batch_id, safe='')}/attempt={attempt}"


class Commits:
    """The commit records of a dataset under root; there is one a batch and try."""

    def __init__(self, spark: SparkSession, root: str, dataset: str):
        self.spark, self.root, self.dataset = spark, root, dataset

    def every(self) -> list[Row]:
        """The records of all tries: some hundred bytes a try, as a manifest has."""
        path = f"{self.root}/commits/{self.dataset}"
        return read_or_empty(self.spark, lambda: self.spark.read.schema(RECORD).parquet(path), RECORD).collect()

    def current(self, every: list[Row] | None = None) -> list[Row]:
        """The record of each batch that counts, its last, in order of seq."""
        best: dict[str, Row] = {}
        for r in self.every() if every is None else every:
            if r["batch_id"] not in best or best[r["batch_id"]]["number"] < r["number"]:
                best[r["batch_id"]] = r
        return sorted(best.values(), key=lambda r: r["seq"])

    def log(self) -> DataFrame:
        """batch_id and metrics of the records that count."""
        return self.spark.createDataFrame([tuple(r[n] for n in LOG.names) for r in self.current()], LOG)

    def begin(self, batch_id: str) -> Attempt:
        every = self.every()
        known = self.current(every)
        mine = next((r for r in known if r["batch_id"] == batch_id), None)
        seq, number = (mine["seq"], mine["number"] + 1) if mine else (max((r["seq"] for r in known), default=0) + 1, 1)
        version = 1 + max((r["version"] for r in every), default=0)
        return Attempt(self.root, self.dataset, batch_id, seq, number, version, uuid.uuid4().hex, tuple(known))

    def commit(self, attempt: Attempt, metrics: tuple, parts: tuple[str, ...]) -> None:
        """From now on readers take this try; parts are the tables that it wrote. One file is added, by one rename."""
        row = (attempt.seq, attempt.number, attempt.version, attempt.batch_id, attempt.attempt, list(parts), *metrics)
        self.spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").parquet(f"{self.root}/commits/{self.dataset}")

    def read(self, part: str, schema: T.StructType, records: list[Row] | None = None, attempt: Attempt | None = None) -> DataFrame:
        """A part of the batches of records (all that count) and of a try that isn't committed yet. seq tells batches apart,
        version which of them was written last."""
        tries = [(r["seq"], r["batch_id"], r["attempt"]) for r in (self.current() if records is None else records) if part in r["parts"]]
        tries += [(attempt.seq, attempt.batch_id, attempt.attempt)] if attempt else []
        with_seq = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in ("seq", "version"))])
        if not tries:
            return self.spark.createDataFrame([], with_seq)
        return self.spark.read.schema(with_seq).parquet(*(path_of(self.root, self.dataset, part, b, a) for _, b, a in tries))

    def write(self, df: DataFrame, attempt: Attempt, part: str, sort: tuple[str, ...] = ()) -> DataFrame:
        """Writes a part of a try, with its seq and version, and returns it as read back."""
        rows = df.withColumns({"seq": F.lit(attempt.seq).cast("long"), "version": F.lit(attempt.version).cast("long")})
        rows = rows.sortWithinPartitions(*sort) if sort else rows
        rows.write.parquet(attempt.path(part))
        return self.spark.read.schema(rows.schema).parquet(attempt.path(part))

    def vacuum(self, parts: tuple[str, ...]) -> int:
        """Deletes tries that readers don't take, as they were replaced or not committed, and returns their number."""
        keep = {(quote(r["batch_id"], safe=""), r["attempt"]) for r in self.current()}
        jvm, n = self.spark._jvm, 0
        for part in parts:
            base = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/{self.dataset}")
            fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, "batch=*/attempt=*")) or []:
                path = status.getPath()
                if (path.getParent().getName().removeprefix("batch="), path.getName().removeprefix("attempt=")) not in keep:
                    fs.delete(path, True)
                    n += 1
        return n
