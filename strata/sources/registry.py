"""Versions of a dataset's schema as JSON, what may change between them, and one reader for files of all of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.readers import read_or_empty
from strata.spec import struct

#: Types that a column may become without loss.
WIDER = {"int": ("bigint", "double", "string"), "bigint": ("string",), "float": ("double", "string"), "double": ("string",), "date": ("timestamp", "string"), "timestamp": ("string",), "boolean": ("string",)}
VERSION = struct("dataset", "schema_json", version="bigint")


class SchemaConflict(ValueError):
    """Columns whose types can't be brought together."""

    def __init__(self, columns: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{n}: {a} and {b}" for n, a, b in columns))
        self.columns = columns


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds values of both; structs by their fields, arrays and maps by their elements. None: there is none."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        try:
            return merged(a, b)
        except SchemaConflict:
            return None
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = wider(a.elementType, b.elementType)
        return inner and T.ArrayType(inner)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        inner = wider(a.valueType, b.valueType)
        return inner and T.MapType(a.keyType, inner)
    x, y = a.simpleString(), b.simpleString()
    return b if y in WIDER.get(x, ()) else a if x in WIDER.get(y, ()) else None


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """Old columns in their order, then new ones, each wide enough for both; SchemaConflict names those that can't be."""
    kinds = {f.name: f.dataType for f in new}
    both = {f.name: wider(f.dataType, kinds.get(f.name, f.dataType)) for f in old} | {n: k for n, k in kinds.items() if n not in old.names}
    bad = [(f.name, f.dataType.simpleString(), kinds[f.name].simpleString()) for f in old if both[f.name] is None]
    if bad:
        raise SchemaConflict(bad)
    return T.StructType([T.StructField(n, k) for n, k in both.items()])


class SchemaRegistry:
    """The schemas under root, a JSON record a version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def versions(self, dataset: str) -> dict[int, T.StructType]:
        rows = read_or_empty(self.spark, lambda: self.spark.read.schema(VERSION).json(self.root), VERSION).where(F.col("dataset") == dataset).collect()
        return {r["version"]: T.StructType.fromJson(json.loads(r["schema_json"])) for r in sorted(rows, key=lambda r: r["version"])}

    def register(self, dataset: str, schema: T.StructType) -> int:
        """The version of the schema; a new one if it isn't the last, which must be compatible with all before."""
        known = self.versions(dataset)
        if known and known[max(known)] == schema:
            return max(known)
        self.merged(dataset, schema)
        n = max(known, default=0) + 1
        self.spark.createDataFrame([(dataset, schema.json(), n)], VERSION).coalesce(1).write.mode("append").json(self.root)
        return n

    def merged(self, dataset: str, *more: T.StructType) -> T.StructType:
        """One schema for all versions."""
        every = [*self.versions(dataset).values(), *more]
        out = every[0]
        for schema in every[1:]:
            out = merged(out, schema)
        return out

    def read(self, dataset: str, path_of, reader) -> DataFrame:
        """Files of all versions as one table: each version's (path_of(version)) are read by reader(path, its schema), and cast
        to the merged schema; columns that a version lacks are null."""
        target, out = self.merged(dataset), None
        for n, schema in self.versions(dataset).items():
            rows = reader(path_of(n), schema)
            rows = rows.select(*((F.col(f"`{f.name}`") if f.name in schema.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in target))
            out = rows if out is None else out.unionByName(rows)
        return out
