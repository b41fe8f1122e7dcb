"""Keyed tables, late ticks, schema versions, digests, located rejects and statistics by days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import incremental, joins, partials, stats
from strata.sources import readers
from strata.sources.registry import SchemaConflict, SchemaRegistry, merged
from strata.streaming import streams

KEYED = T.StructType([T.StructField("k", T.StringType()), T.StructField("d", T.DateType()), T.StructField("v", T.IntegerType())])


def keyed(path):
    return streams.KeyedTable(str(path), KEYED, ["k", "d"], [F.desc("v")], F.date_format("d", "yyyy-MM"))


def rows(spark, *spec):
    return spark.createDataFrame([(k, d and dt.date(2001, *d), v) for k, d, v in spec], KEYED)


def test_a_keyed_table_rewrites_touched_buckets(spark, tmp_path):
    table = keyed(tmp_path)
    assert table.read(spark).count() == 0
    table.upsert(rows(spark, ("a", (1, 1), 1), ("a", (2, 1), 2), ("n", None, 3), ("a", (1, 1), 0)), 0)
    table.upsert(rows(spark, ("a", (1, 1), 5), ("b", (1, 9), 6), ("n", None, 1)), 1)
    table.upsert(rows(spark), 2)
    got = lambda: sorted(((r.k, str(r.d), r.v) for r in table.read(spark).collect()))
    want = [("a", "2001-01-01", 5), ("a", "2001-02-01", 2), ("b", "2001-01-09", 6), ("n", "None", 3)]
    assert got() == want and table.manifest(spark) == {"2001-01": 1, "none": 1, "2001-02": 0}
    assert not (tmp_path / "data/version=1/bucket=2001-02").exists()  # not touched by the second batch
    table.upsert(rows(spark, ("a", (1, 1), 5), ("b", (1, 9), 6), ("n", None, 1)), 1)  # a batch that is given again
    assert got() == want


def test_a_crash_before_the_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    table = keyed(tmp_path)
    table.upsert(rows(spark, ("a", (1, 1), 1)), 0)
    create = type(spark).createDataFrame

    def fail(self, data, schema=None, *more, **other):
        if schema is streams.KeyedTable.MANIFEST and data:
            raise OSError("lost")
        return create(self, data, schema, *more, **other)

    new = rows(spark, ("a", (1, 1), 7), ("c", (3, 1), 8))
    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    with pytest.raises(OSError):
        table.upsert(new, 1)
    monkeypatch.setattr(type(spark), "createDataFrame", create)
    assert [r.v for r in table.read(spark).collect()] == [1]
    table.upsert(new, 1)
    assert sorted(r.v for r in table.read(spark).collect()) == [7, 8]


def test_no_tick_is_lost(spark, tmp_path):
    """On time and late ticks are all of them; a batch that is given again divides its ticks as before; late ones can be added."""
    sink = streams.ticks_sink(str(tmp_path), "ts", "s", "p", "i")

    def ticks(*spec):
        return spark.createDataFrame([(h is not None and dt.datetime(2001, 1, 1) + dt.timedelta(hours=h) or None, "a", float(p), i) for h, p, i in spec], "ts timestamp, s string, p double, i int")

    first, second, third = ticks((0, 5, 1), (30, 6, 2), (30.5, 4, 3)), ticks((1, 9, 4), (7, 8, 5), (100, 7, 6), (None, 3, 7)), ticks((75, 2, 8), (77, 1, 9))
    for n, df in ((0, first), (1, second), (1, second), (2, third), (0, first)):
        sink(df, n)
    marks = {r.batch: (r.n_on_time, r.n_late) for r in spark.read.parquet(f"{tmp_path}/marks").select("batch", "n_on_time", "n_late").collect()}
    assert marks == {0: (3, 0), 1: (2, 2), 2: (1, 1)}
    late = spark.read.parquet(f"{tmp_path}/late")
    assert sorted(r.i for r in late.collect()) == [4, 7, 8]
    bars = spark.read.parquet(f"{tmp_path}/bars").drop("batch")
    hourly = {(r.bar_start.day, r.bar_start.hour): (r.open, r.high, r.low, r.close, r.volume) for r in streams.roll_up(bars, "1 hour").collect()}
    assert hourly[2, 6] == (6.0, 6.0, 4.0, 4.0, 2) and len(hourly) == 5 and sum(v[4] for v in hourly.values()) == 6
    everything = bars.unionByName(streams.tick_partials(late.where("ts is not null").drop("batch"), "ts", "s", "p", "i"))
    daily = {r.bar_start.day: (r.open, r.high, r.low, r.close, r.volume) for r in streams.roll_up(everything, "1 day").collect()}
    assert daily == {1: (5.0, 9.0, 5.0, 8.0, 3), 2: (6.0, 6.0, 4.0, 4.0, 2), 4: (2.0, 2.0, 1.0, 1.0, 2), 5: (7.0, 7.0, 7.0, 7.0, 1)}


def test_schema_versions(spark, tmp_path):
    ddl = T.StructType.fromDDL
    registry = SchemaRegistry(spark, str(tmp_path))
    one, two = ddl("a int, s struct<x: int>, l array<int>"), ddl("a bigint, l array<bigint>, s struct<x: double, y: string>, n date")
    assert [registry.register("d", s) for s in (one, one, two, two)] == [1, 1, 2, 2] and registry.register("other", two) == 1
    assert registry.versions("d") == {1: one, 2: two}
    assert registry.merged("d").simpleString() == "struct<a:bigint,s:struct<x:double,y:string>,l:array<bigint>,n:date>"
    with pytest.raises(SchemaConflict, match="a: bigint and date") as e:
        registry.register("d", ddl("a date"))
    assert e.value.columns == [("a", "bigint", "date")] and len(registry.versions("d")) == 2
    with pytest.raises(SchemaConflict):
        merged(ddl("s struct<x: int>"), ddl("s struct<x: date>"))


def test_digests_spare_unchanged_buckets(spark):
    old = spark.range(1000).selectExpr("id k", "cast(id % 7 as string) v", "rand() run")
    new = old.where("k <> 17").withColumn("v", F.when(F.col("k") == 500, None).otherwise(F.col("v"))).unionAll(spark.createDataFrame([(5000, "x", 0.0)], "k long, v string, run double"))
    old, new = old.cache(), new.cache()
    digests = [incremental.bucket_digests(x, ["k"], 16, ("run",)) for x in (old, new, new.withColumn("run", F.rand()))]
    got = incremental.diff_by_digests(old, new, *digests[:2], ["k"], 16, ("run",))
    want = incremental.snapshot_diff(old, new, ["k"], ("run",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.k: r.change for r in got.where("change <> 'unchanged'").collect()} == {17: "removed", 500: "changed", 5000: "new"}
    still = incremental.diff_by_digests(new, new, *digests[1:], ["k"], 16, ("run",))
    assert "Exchange" not in still._jdf.queryExecution().executedPlan().toString() and still.count() == 1000


def test_malformed_rows_and_their_places(spark, tmp_path):
    for name, text in (("a", "i,s\n1,x\nmany,y\n2,z\n"), ("b", "i,s\n3,x\n4,y,z\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    good, bad = readers.read_csv_located(spark, str(tmp_path), T.StructType.fromDDL("i int, s string"))
    assert sorted(r.i for r in good.collect()) == [1, 2, 3]
    assert sorted((r.value, r.file[-5:], r.part_start, r.s) for r in bad.collect()) == [("4,y,z", "b.csv", 0, "y"), ("many,y", "a.csv", 0, "y")]


def plain(df):
    out = stats.running_extremes(stats.rolling_range(stats.rolling_mean(df, ["k"], "d"), ["k"], "d"), ["k"], "d")
    return out


@pytest.mark.parametrize("limit", [None, 0])
def test_statistics_by_days_are_those_of_rows(spark, monkeypatch, tmp_path, limit):
    """A hot key, a hot day, null prices, keys and days; hot rows are dealt over several tasks."""
    monkeypatch.setattr(partials, "TOGETHER", 10)
    rng = random.Random(4)
    spec = [(i, rng.choice(["a", "a", "b", "c"]), dt.date(2001, 1, 1) + dt.timedelta(days=rng.choice([0, rng.randrange(900)])), *(rng.choice([None, rng.randrange(1, 900) / 4, rng.randrange(1, 900) / 4]) for _ in range(4))) for i in range(600)]
    spec += [(700, None, dt.date(2001, 1, 1), 1.0, 1.0, 1.0, 1.0), (701, "a", None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(spec, "i int, k string, d date, open double, high double, low double, close double")
    partials.trailing(partials.by_day(df, ["k"], "d"), ["k"], "d").write.parquet(f"{tmp_path}/days")
    got = partials.attach(df, spark.read.parquet(f"{tmp_path}/days"), ["k"], "d", limit)
    names = ["i", "rolling_avg_open", "rolling_avg_close", "rolling_high", "rolling_low", "running_high", "running_low"]
    known = lambda out: sorted(map(tuple, out.where("k is not null and d is not null").select(names).collect()))
    assert known(got) == known(plain(df)) and got.count() == 602
    assert all(x is None for r in got.where("i >= 700").select(names[1:]).collect() for x in r)


def test_broadcast_by_measured_bytes(spark):
    side = spark.range(100).selectExpr("id k", "repeat('x', 100) v", "array(1, 2) a", "struct(id) s")
    assert 15_000 < joins.bytes_of(side) < 30_000
    plans = [joins.joined(spark.range(10).withColumnRenamed("id", "k"), side, "k", "left", n)._jdf.queryExecution().optimizedPlan().toString() for n in (1 << 20, 10)]
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
