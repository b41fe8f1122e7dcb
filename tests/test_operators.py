"""Operators on hand-made rows: the rules of the data model and the cases that go wrong elsewhere."""

import datetime as dt
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import rounded
from strata.operators import clean, dedupe, enrich, gold, incremental, quality, reshape, stats
from strata.plans import pipelines as pl
from strata.sources import readers, sinks
from strata.spec import BAR_FIELDS, DAILY, DAILY_SERIES, OVERVIEW_NAMES, OVERVIEW_SCHEMA, STATE_SCHEMA, WEEKLY, overview_types, series_schema
from strata.streaming import streams

BAR = "row_id long, symbol string, day_date string, open string, high string, low string, close string, volume string, last_refreshed string"
GOOD = dict(row_id=1, symbol="a", day_date="2001-01-02", open="10", high="12", low="9", close="11", volume="5", last_refreshed="2001-01-03")


def bars(spark, *changes):
    rows = [{**GOOD, "row_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in GOOD) for r in rows], BAR)


REASONS = [
    ({}, None), ({"symbol": " NA "}, "Missing symbol"), ({"day_date": "not-a-date"}, "Missing or invalid day date"), ({"day_date": "2026-08-06 16:00:01"}, "Missing or invalid day date"),
    ({"last_refreshed": "NULL"}, "Missing or invalid last refreshed date"), ({"open": "abc"}, "Missing or invalid open price"), ({"high": "none"}, "Missing or invalid high price"),
    ({"low": "-"}, "Missing or invalid low price"), ({"close": None}, "Missing or invalid close price"), ({"volume": "1.5x"}, "Missing or invalid volume"), ({"volume": ""}, "Missing or invalid volume"),
    ({"open": "NaN"}, "Open price is not a number"), ({"close": "nan"}, "Close price is not a number"), ({"open": "0"}, "Open price must be greater than zero"), ({"high": "-1"}, "High price must be greater than zero"),
    ({"low": "0"}, "Low price must be greater than zero"), ({"close": "-2"}, "Close price must be greater than zero"), ({"volume": "-5"}, "Volume cannot be negative"), ({"volume": "0"}, None),
    ({"high": "8"}, "High price cannot be lower than low price"), ({"symbol": None, "open": "abc"}, "Missing symbol"),
]


def test_first_failing_rule(spark):
    rows = pl.typed_bars(bars(spark, *(c for c, _ in REASONS)))
    got = {r.row_id: (r.validation_reason, r.validation_status) for r in rows.collect()}
    assert got == {i: (reason, "INVALID" if reason else "VALID") for i, (_, reason) in enumerate(REASONS)}
    valid, rejected = quality.split(rows)
    assert valid.unionByName(rejected).exceptAll(rows).count() == 0 and valid.count() + rejected.count() == rows.count()
    assert quality.counts(rows).first().asDict() == {"n_rows": len(REASONS), "n_valid": 2, "n_invalid": len(REASONS) - 2}
    assert {r.validation_reason: r.n for r in quality.reason_counts(rows).collect()}["Missing symbol"] == 2


def test_counts_come_with_the_write(spark, tmp_path):
    rows, seen = quality.observed_counts(pl.typed_bars(bars(spark, {}, {"open": "x"})))
    rows.write.parquet(f"{tmp_path}/t")
    assert seen.get == {"n_rows": 2, "n_valid": 1, "n_invalid": 1}


@pytest.mark.parametrize("token", ["", "n/a", "N/A", "na", "Na", " NULL ", "none", "None", "-", " - "])
def test_null_tokens(spark, token):
    df = spark.createDataFrame([(token, "n/ab")], "a string, b string")
    assert tuple(clean.null_tokens(df).first()) == (None, "n/ab")


def test_types(spark):
    df = spark.createDataFrame([("1", "99999999999", "x", "2001-02-30"), ("2147483648", "1.5e3", "1.5", "2001-02-28")], "i string, l string, d string, t string")
    got = [tuple(r) for r in clean.cast_by_spec(df, {"i": "int", "l": "bigint", "d": "double", "t": "date"}).collect()]
    assert got[0] == (1, 99999999999, None, None) and got[1][0] is None and got[1][2:] == (1.5, dt.date(2001, 2, 28))


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (-1.005,), (2.675,), (1e300,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(rounded(F.col("x"))).collect()]
    assert got[:6] == [1.01, 0.29, -1.01, 2.68, 1e300, None] and math.isnan(got[6])


def test_change_and_movement(spark):
    df = spark.createDataFrame([(10.0, 11.0), (10.0, 9.0), (10.0, 10.0), (0.0, 5.0), (None, 1.0)], "open double, close double")
    got = [tuple(r)[2:] for r in enrich.movement(enrich.price_change(df, "daily")).collect()]
    assert got[:4] == [(1.0, 10.0, "Bull"), (-1.0, -10.0, "Bear"), (0.0, 0.0, "Neutral"), (5.0, None, "Bull")] and got[4][:2] == (None, None)


def test_iso_week_with_calendar_year(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1),)], "d date")
    assert tuple(enrich.calendar(df, "d", WEEKLY.calendar).first())[1:] == (2021, 1, 53)


def test_empty_series_disappear(spark):
    rows = [(("A", "2001-01-03"), {"2001-01-02": ("1", "2", "1", "2", "3"), "2001-01-01": None}), (("B", None), {}), (("C", None), None)]
    df = spark.createDataFrame(rows, series_schema(DAILY_SERIES))
    got = reshape.bars_of(df, DAILY_SERIES, "day_date", BAR_FIELDS)
    assert sorted((r.symbol, r.day_date, r.open) for r in got.collect()) == [("A", "2001-01-01", None), ("A", "2001-01-02", "1")]
    assert [r.day_date for r in reshape.bars_of(df, DAILY_SERIES, "day_date", BAR_FIELDS, after="2001-01-01").collect()] == ["2001-01-02"]
    assert reshape.explode_map(df, DAILY_SERIES, "k", "v", outer=True).count() == 4
    arrays = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "i int, a array<int>")
    assert reshape.explode_array(arrays, "a", "x").count() == 2 and reshape.explode_array(arrays, "a", "x", outer=True).count() == 4


def test_overview(spark):
    row = dict.fromkeys(OVERVIEW_NAMES) | {"Symbol": " ibm ", "Country": " n/a ", "CIK": " 51143 ", "EBITDA": "None", "Beta": " - ", "52WeekHigh": "1.5", "DividendDate": "2026-02-30", "LatestQuarter": "2026-06-30"}
    out = pl.silver_overview(spark.createDataFrame([tuple(row.values())], OVERVIEW_SCHEMA), "2001-08-02 00:00:00").first()
    assert len(out) == 57 and len(overview_types()) == 53 - 10
    assert (out.symbol, out.country, out.sector, out.official_site, out.cik, out.ebitda, out.beta, out.fifty_two_week_high, out.dividend_date, out.latest_quarter) == ("IBM", "Unknown", "Unknown", "Not Available", 51143, None, None, 1.5, None, dt.date(2026, 6, 30))
    assert (out.year, out.month, out.day) == (2001, 8, 2)


def test_keep_one_and_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", None, 9), ("b", None, 1)], "k string, t int, v int")
    first = dedupe.keep_one(df, ["k"], [F.asc_nulls_last("t")])
    assert sorted((r.k, r.v) for r in first.collect()) == [("a", 5), ("b", 1)]
    assert sorted((r.k, r.v) for r in dedupe.latest(df, ["k"], ["t"]).collect()) == [("a", 4), ("b", 1)]
    assert dedupe.keep_one(first, ["k"], [F.asc_nulls_last("t")]).exceptAll(first).count() == 0
    assert [(r.k, r.n) for r in quality.duplicates(df, ["k"]).collect()] == [("a", 3)]


def test_gold_does_not_fan_out(spark):
    b = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, x int")
    ref = spark.createDataFrame([("a", 1, 0), ("a", 2, 0)], "symbol string, t int, processed_at int")
    out = gold.enrich_left(b, dedupe.latest(ref, ["symbol"], ["t"]))
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, 2), ("b", 2, None)]
    assert [tuple(r) for r in gold.unmatched(b, ref).collect()] == [("b", 2)]


def test_marks(spark):
    df = spark.createDataFrame([("a", dt.date(2001, 1, d)) for d in (1, 2, 3)] + [("new", dt.date(1990, 1, 1))], "symbol string, day date")
    marks = spark.createDataFrame([("a", dt.date(2001, 1, 2))], "symbol string, mark date")
    got = lambda n: sorted((r.symbol, r.day.day) for r in incremental.after_mark(df, marks, ["symbol"], "day", n).collect())
    assert got(0) == [("a", 3), ("new", 1)] and got(1) == [("a", 2), ("a", 3), ("new", 1)]


def test_content_hash(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"x{i}", i / 7) for i in range(200)], "a int, b string, c double")
    h = incremental.content_hash(df).first()[0]
    assert h == incremental.content_hash(df.orderBy(F.desc("a")).repartition(7).select("c", "b", "a")).first()[0]
    assert h == incremental.content_hash(df.withColumn("run", F.rand()), exclude=("run",)).first()[0]
    other = [df.withColumn("b", F.coalesce("b", F.lit(""))), df.union(df.limit(1)), df.where("a <> 5"), df.drop("b")]
    assert len({h, *(incremental.content_hash(o).first()[0] for o in other)}) == 5
    pipes = [spark.createDataFrame([r], "a string, b string") for r in (("x|", "y"), ("x", "|y"), ("x\\", "|y"), ("\\N", None))]
    assert len({incremental.content_hash(p).first()[0] for p in pipes}) == 4


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, ""), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in incremental.snapshot_diff(old, new, ["k"]).collect()} == {1: "removed", 2: "unchanged", 3: "changed", 4: "new"}


def test_reading_guards(spark, tmp_path):
    schema = T.StructType.fromDDL("a int")
    assert readers.read_or_empty(spark, lambda: spark.read.schema(schema).parquet(f"{tmp_path}/none"), schema).count() == 0
    with pytest.raises(AnalysisException):
        readers.read_or_empty(spark, lambda: spark.range(1).select("nothing"), schema)
    (tmp_path / "r.csv").write_text('a,b\n1,"x\ny"\nmany,z\n3,\n')
    full = T.StructType.fromDDL("a int, b string")
    good, bad = readers.split_corrupt(readers.read_csv(spark, f"{tmp_path}/r.csv", full, corrupt=True, multi_line=True).cache())
    assert sorted(r.a for r in good.collect()) == [1, 3] and bad.count() == 1
    assert readers.read_csv(spark, f"{tmp_path}/r.csv", full, mode="DROPMALFORMED", multi_line=True).count() >= 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, f"{tmp_path}/r.csv", full, mode="FAILFAST", multi_line=True).collect()


def test_csv_keeps_null_and_empty_apart(spark, tmp_path):
    schema = T.StructType.fromDDL("a string, d double, t date, s timestamp")
    df = spark.createDataFrame([("", 1.1, dt.date(2001, 1, 1), dt.datetime(2001, 1, 1, 5, 6, 7, 123456)), (None, None, None, None), ('q"uo,te\nd\\', 0.1 + 0.2, None, None)], schema)
    sinks.write_csv(df, f"{tmp_path}/c")
    back = readers.read_csv(spark, f"{tmp_path}/c", schema, multi_line=True)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_errors_and_documents(spark, tmp_path):
    for name, text in (("a", '{"Note": "slow down"}'), ("b", '{"Meta Data": {"2. Symbol": "B"}}'), ("c", '{"data": {"Note": "inside"}}'), ("d", "not json")):
        (tmp_path / f"{name}.json").write_text(text)
    data, errors = readers.split_error_payloads(readers.read_documents(spark, str(tmp_path)))
    assert data.count() == 3 and [r.error for r in errors.collect()] == ["slow down"]
    assert {r["Meta Data"] and r["Meta Data"]["2. Symbol"] for r in readers.parse_documents(data, series_schema(DAILY_SERIES)).collect()} == {"B", None}


def test_files_of_many_documents(spark, tmp_path, monkeypatch, data):
    """Documents of several lines stay whole, and the raw files of a query are fewer than its documents by far: a file each took all its time."""
    from strata.plans import catalog

    texts = ['{"Note":\n "slow down"}', '{"a": 1,\r\n"b": "\\u001e"}', '{"a": 2}']
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.option("lineSep", readers.RECORD).text(f"{tmp_path}/many")
    read = readers.read_documents(spark, f"{tmp_path}/many", "*.txt", readers.RECORD)
    assert sorted(r.value for r in read.collect()) == sorted(texts)
    good, errors = readers.split_error_payloads(read)
    assert good.count() == 2 and [r.error for r in errors.collect()] == ["slow down"]
    monkeypatch.setattr(catalog.sinks, "scratch", lambda spark: f"{tmp_path}/raw")
    counted = catalog.QUERIES["guard_raw_files"](spark, data).agg(F.sum("n")).first()[0]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert counted == docs.count() and len([*(tmp_path / "raw").rglob("*.txt")]) <= docs.rdd.getNumPartitions() + counted // catalog.PAGE


def test_partition_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000), (2, 2001)], "a int, y int")
    sinks.write_parquet(df, f"{tmp_path}/p", ("y",))
    sinks.write_parquet(spark.createDataFrame([(3, 2001)], "a int, y int"), f"{tmp_path}/p", ("y",))
    assert sorted(map(tuple, readers.read_parquet(spark, f"{tmp_path}/p").collect())) == [(1, 2000), (3, 2001)]
    plan = readers.read_run(spark, f"{tmp_path}/p", y=2000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan


def history(spark, n=80):
    rows = [(s, dt.date(2001, 8, 1) - dt.timedelta(days=i * 7), float(i % 13 + 1), float(i % 13 + 3), float(i % 5 + 1) / 2, float(i % 7 + 1)) for s in "ab" for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, day_date date, open double, high double, low double, close double")


def test_strategies_agree(spark):
    df = history(spark)
    one, two = (stats.as_of_stats(df, ["symbol"], "day_date", "2001-08-01", s) for s in ("window", "agg"))
    assert one.exceptAll(two.select(one.columns)).count() == 0 and one.count() == two.count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 1


def test_stats_are_null_without_recent_rows(spark):
    out = stats.as_of_stats(history(spark), ["symbol"], "day_date", "2010-01-01").first()
    assert out.thirty_day_avg_open is None and out.fifty_two_week_high is None and out.all_time_high == 15.0


def test_increment_equals_whole(spark):
    df, cut = history(spark), dt.date(2001, 5, 1)
    late = F.col("day_date") > F.lit(cut)
    got = stats.history_stats(df, df.where(late), ["symbol"], "day_date", "2001-08-01")
    want = stats.as_of_stats(df, ["symbol"], "day_date", "2001-08-01").where(late)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_prefilter_is_below_the_explode(spark):
    df = spark.createDataFrame([], series_schema(DAILY_SERIES))
    plan = reshape.bars_of(df, DAILY_SERIES, "day_date", BAR_FIELDS, after="2001-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_filter" in plan


def test_slices_equal_full_load(spark, tmp_path):
    days = [f"2001-01-{d:02d}" for d in range(1, 25)]
    rows = bars(spark, *({"day_date": d, "symbol": s, "open": str(i + 1), "high": "99", "low": "1"} for i, d in enumerate(days) for s in "xy")).cache()

    def load(root, *cuts):
        run = pl.Run(spark, f"{tmp_path}/{root}", "b0", "2001-08-02 00:00:00", "2001-01-24")
        for n, (lo, hi) in enumerate(zip(("", *cuts), (*cuts, "9"), strict=True)):
            run.batch_id = f"b{n}"
            run.daily(rows.where((F.col("day_date") > lo) & (F.col("day_date") <= hi)))
        before = run.bars().count()
        run.batch_id = "again"
        assert run.daily(rows).first().n_written == 0
        out = run.bars()
        assert out.count() == before
        return out, run

    whole, _ = load("whole")
    sliced, run = load("sliced", "2001-01-07", "2001-01-20")
    same = [c for c in DAILY.columns if c not in stats.as_of_exprs("day_date", "2001-01-24")]
    assert whole.select(same).exceptAll(sliced.select(same)).count() == 0 and whole.count() == sliced.count()
    last = F.col("day_date") > F.lit("2001-01-20").cast("date")
    assert whole.where(last).exceptAll(sliced.where(last).select(whole.columns)).count() == 0
    marks = incremental.latest_state(run.state)
    assert sorted((r.watermark_key, r.watermark_value) for r in marks.collect()) == [("X", "2001-01-24"), ("Y", "2001-01-24")]
    assert run.state.schema == STATE_SCHEMA


def test_unchanged_overview_is_not_written(spark, tmp_path):
    run = pl.Run(spark, str(tmp_path), "b1", "2001-08-02 00:00:00", "2001-08-01")
    record = lambda beta: spark.createDataFrame([tuple((dict.fromkeys(OVERVIEW_NAMES) | {"Symbol": "A", "Beta": beta}).values())], OVERVIEW_SCHEMA)
    assert run.overview(record("1.5")).first().changed
    run.batch_id, run.run_ts = "b2", "2001-08-03 00:00:00"
    assert not run.overview(record("1.5")).first().changed
    run.batch_id, run.run_ts = "b3", "2001-08-04 00:00:00"
    assert run.overview(record("1.6")).first().changed


def test_schema_drift(spark):
    got = readers.schema_drift(spark.createDataFrame([], "a int, b string"), T.StructType.fromDDL("a long, c date"))
    assert [tuple(r) for r in got.orderBy("column").collect()] == [("a", "bigint", "int", "type"), ("b", None, "string", "unexpected"), ("c", "date", None, "missing")]


def test_gold_has_current_statistics(spark, tmp_path):
    """After two loads each symbol has one range, on all its rows, with either strategy; a load without new bars writes none."""
    days = [f"2001-01-{d:02d}" for d in range(1, 9)]
    rows = bars(spark, *({"day_date": d, "symbol": "x", "open": str(i + 1), "high": str(90 + i), "low": "1"} for i, d in enumerate(days))).cache()
    run = pl.Run(spark, str(tmp_path), "b1", "2001-08-02 00:00:00", "2001-01-24")
    for batch, part in (("b1", rows.where("day_date < '2001-01-05'")), ("b2", rows), ("b3", rows)):
        run.batch_id = batch
        last = run.daily(part).first()
    assert last.skipped and (last.n_written, str(last.old_mark)) == (0, "2001-01-08") and not (tmp_path / "silver/daily/batch=b3").exists()
    for strategy in ("window", "agg", "blocks"):
        got = run.silver(strategy).collect()
        assert len(got) == 8 and {(r.all_time_high, r.all_time_low) for r in got} == {(97.0, 1.0)} and None not in {r.thirty_day_avg_open for r in got}


def test_quarantine_and_landing_can_be_repeated(spark, tmp_path):
    bad = spark.createDataFrame([(1, "Missing symbol"), (2, "Volume cannot be negative")], "row_id int, validation_reason string")
    for batch in ("b1", "b2", "b2"):
        sinks.write_quarantine(bad, f"{tmp_path}/q", batch)
    assert spark.read.parquet(f"{tmp_path}/q").count() == 4
    docs = spark.createDataFrame([("k", "v", "a"), ("l", "w", None)], "key string, value string, name string")
    for day in ("2001-01-01", "2001-01-02", "2001-01-02"):
        sinks.land(docs, f"{tmp_path}/l", F.col("name"), day)
    sinks.land(docs, f"{tmp_path}/l", "b", "2001-01-02")
    assert readers.read_landed(spark, f"{tmp_path}/l").count() == 6


def test_late_ticks_are_dropped(spark, tmp_path):
    def run(*ticks):
        rows = spark.createDataFrame([(dt.datetime(2001, 1, d, 12), "a", float(v), i) for d, v, i in ticks], "ts timestamp, k string, v double, i int")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        streams.stream_apply(streams.tumbling_bars(source, "ts", "k", "v", "i"), lambda df: df, streams.by_batch(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", "update")

    run((1, 5, 1), (8, 6, 2))
    run((1, 9, 3), (8, 7, 4), (9, 8, 5))  # the first is a week late
    got = streams.newest(spark.read.parquet(f"{tmp_path}/out"), ["symbol", "bar_start"])
    assert sorted((r.bar_start.day, r.volume, r.high) for r in got.collect()) == [(1, 1, 5.0), (8, 2, 7.0), (9, 1, 8.0)]


def test_compact(spark, tmp_path):
    spark.range(100).repartition(7).write.parquet(f"{tmp_path}/many")
    sinks.compact(spark, f"{tmp_path}/many", f"{tmp_path}/few", 60)
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 2 and spark.read.parquet(f"{tmp_path}/few").count() == 100


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "yarn"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="share"):
        sinks.scratch(Session())
