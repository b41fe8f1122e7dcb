"""Loads that are repeated, that crash, and that start from landed files; statistics from stored blocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.operators import partials, stats
from strata.plans import pipelines as pl
from strata.sources import readers, sinks
from strata.sources.commits import Commits
from strata.spec import AS_OF_STATS, DAILY
from tests.test_operators import bars

AT = "2001-08-02 00:00:00"


def days(spark, *spec):
    """Bars of (day, symbol, open)."""
    return bars(spark, *({"day_date": d, "symbol": s, "open": str(o), "high": str(o + 50), "low": "1"} for d, s, o in spec))


def lake(spark, root, *loads):
    run = pl.Run(spark, str(root), "", AT, "2001-01-24")
    for batch, rows, late in loads:
        run.batch_id = batch
        run.daily(rows, late)
    return run


def state(run):
    return sorted((r.watermark_key, r.watermark_value, r.batch_id) for r in run.state.collect())


def same(a, b):
    """Bars with their statistics, log, rejected rows and state are those of the other lake."""
    for x, y in ((a.silver("blocks"), b.silver("window")), (a.log(), b.log()), (a.quarantine(), b.quarantine())):
        assert sorted(map(str, x.select(y.columns).collect())) == sorted(map(str, y.collect()))
    assert state(a) == state(b)


@pytest.fixture
def parts(spark):
    one = days(spark, *((f"2001-01-{d:02d}", s, d) for d in range(1, 9) for s in "xy")).cache()
    two = days(spark, *((f"2001-01-{d:02d}", s, d) for d in range(7, 15) for s in "xz"), ("2001-01-10", None, 3)).cache()
    more = two.unionByName(days(spark, ("2001-01-20", "x", 7), ("2001-02-03", "z", 9)))
    return one, two, more


@pytest.mark.parametrize("case", ["same", "more", "late", "fewer"])
def test_a_repeated_batch_is_as_one_clean_load(spark, tmp_path, parts, case):
    one, two, more = parts
    rows, late = {"same": (two, 0), "more": (more, 0), "late": (two, 5), "fewer": (two.where("day_date < '2001-01-11'"), 0)}[case]
    got = lake(spark, tmp_path / "again", ("b1", one, 0), ("b2", two, 0), ("b2", rows, late))
    same(got, lake(spark, tmp_path / "clean", ("b1", one, 0), ("b2", rows, late)))
    if case == "more":
        before = got.bars().count()
        assert Commits(spark, got.root, DAILY.name).vacuum(("silver", "blocks")) == 2  # the first try's
        assert got.bars().count() == before


def test_an_early_batch_repeated_late(spark, tmp_path, parts):
    """Batches since keep what they loaded, and their rows win; blocks are right although the early one is written last."""
    one, two, _ = parts
    changed = one.withColumn("open", F.lit("40"))
    run = lake(spark, tmp_path, ("b1", one, 0), ("b2", two, 3), ("b1", changed, 0))
    opens = {(r.symbol, r.day_date.day): r.open for r in run.bars().collect()}
    assert opens["X", 8] == 8.0 and opens["X", 1] == 40.0 and opens["Y", 8] == 40.0 and len(opens) == 30
    assert sorted(map(str, run.silver("blocks").collect())) == sorted(map(str, run.silver("window").collect()))
    assert {r.watermark_key: r.watermark_value for r in run.state_before(DAILY.name).where("seq = 2").collect()} == {"X": "2001-01-14", "Z": "2001-01-14"}


@pytest.mark.parametrize("crash", ["blocks", "commit"])  # after data and state
def test_a_crash_leaves_all_as_it_was(spark, tmp_path, parts, monkeypatch, crash):
    one, two, _ = parts
    run = lake(spark, tmp_path / "crash", ("b1", one, 0))
    before, write, commit = sorted(map(str, run.silver("blocks").collect())), Commits.write, Commits.commit

    def fail(self, df, attempt, part, *more):
        if part == crash:
            raise OSError("lost")
        return write(self, df, attempt, part, *more)

    def lost(self, *args):
        raise OSError("lost")

    monkeypatch.setattr(Commits, "write", fail)
    if crash == "commit":
        monkeypatch.setattr(Commits, "commit", lost)
    run.batch_id = "b2"
    with pytest.raises(OSError):
        run.daily(two)
    monkeypatch.setattr(Commits, "write", write)
    monkeypatch.setattr(Commits, "commit", commit)
    assert sorted(map(str, run.silver("blocks").collect())) == before
    run.daily(two)
    same(run, lake(spark, tmp_path / "clean", ("b1", one, 0), ("b2", two, 0)))


def test_a_late_row_moves_no_mark_back(spark, tmp_path):
    run = lake(spark, tmp_path, ("b1", days(spark, ("2001-01-10", "x", 5)), 0), ("b2", days(spark, ("2001-01-07", "x", 6)), 5))
    assert run.bars().count() == 2
    run.batch_id = "b3"
    assert run.daily(days(spark, ("2001-01-09", "x", 7))).first().skipped


def document(symbol, rows):
    series = ",\n".join(f'"{d}": {{"1. open": "{o}", "2. high": "99", "3. low": "1", "4. close": "2", "5. volume": "3"}}' for d, o in rows)
    return f'{{\n"Meta Data": {{\n "2. Symbol": "{symbol}", "3. Last Refreshed": "2001-01-30"}},\n"Time Series (Daily)": {{\n{series}\n}}\n}}'


def test_files_are_read_once(spark, tmp_path):
    run, landing = pl.Run(spark, f"{tmp_path}/lake", "b0", AT, "2001-01-24"), f"{tmp_path}/landing"
    assert run.daily_files(landing).first().n_rows == 0  # nothing has landed yet
    land = lambda day, **docs: sinks.land(spark.createDataFrame(list(docs.items()), "key string, value string"), landing, "daily", day)
    land("2001-01-01", a=document("a", [("2001-01-02", 5), ("2001-01-03", 6)]), e='{"Note": "slow down"}')
    run.batch_id = "b1"
    assert run.daily_files(landing).first()[1:5] == (2, 2, 0, 2)
    land("2001-01-02", a=document("a", [("2001-01-03", 7), ("2001-01-04", 8)]), b=document("b", [("bad", 1)]))
    for _ in range(2):  # repeated, it reads its own files again
        run.batch_id = "b2"
        assert run.daily_files(landing).first()[1:5] == (3, 2, 1, 1)
    run.batch_id = "b3"
    assert run.daily_files(landing).first()[1:5] == (0, 0, 0, 0)
    assert {(r.symbol, r.day_date.day, r.open) for r in run.bars().collect()} == {("A", 2, 5.0), ("A", 3, 6.0), ("A", 4, 8.0)}
    assert [(r.key, r.error) for r in run.rejected_documents().collect()] == [("e", "slow down")]
    assert [(r.batch_id, r.validation_reason) for r in run.quarantine().select("batch_id", "validation_reason").collect()] == [("b2", "Missing or invalid day date")]


def test_new_files_by_time(spark, tmp_path):
    """A file that is written again counts as new."""
    spark.range(3).write.parquet(f"{tmp_path}/f")
    none = spark.createDataFrame([], "path string, modified timestamp, bytes long")
    seen = readers.new_files(spark, f"{tmp_path}/f", none)
    assert seen.count() >= 1 and readers.new_files(spark, f"{tmp_path}/f", seen).count() == 0
    assert readers.new_files(spark, f"{tmp_path}/f", seen.withColumn("bytes", F.col("bytes") + 1)).count() == seen.count()


def long_history(spark, n=900):
    rows = [(s, dt.date(2001, 8, 1) - dt.timedelta(days=i), float(i * 7 % 13 + 1) if i % 11 else None, float(i * 5 % 17 + 3), float(i % 5 + 1) / 2, float(i % 7 + 1)) for s, step in (("a", 1), ("b", 3), ("c", 50)) for i in range(0, n, step)]
    return spark.createDataFrame(rows, "symbol string, day_date date, open double, high double, low double, close double")


@pytest.mark.parametrize("as_of", ["2001-08-01", "2001-03-31", "2001-03-01", "2000-02-29", "1998-01-01", "2010-01-01"])
def test_blocks_give_the_statistics_of_all_rows(spark, as_of):
    df = long_history(spark)
    months = partials.blocks(df, ["symbol"], "day_date")
    got = partials.as_of_summary(months, df.where(partials.cut_months("day_date", as_of)), ["symbol"], "day_date", as_of)
    want = stats.as_of_summary(df, ["symbol"], "day_date", as_of)
    assert sorted(map(tuple, got.select("symbol", *AS_OF_STATS).collect())) == sorted(map(tuple, want.select("symbol", *AS_OF_STATS).collect()))


def test_blocks_merge(spark):
    df = long_history(spark)
    halves = [partials.blocks(df.where(c), ["symbol"], "day_date") for c in ("day(day_date) < 15", "day(day_date) >= 15")]
    got = partials.merge(halves[0].unionByName(halves[1]), ["symbol", "month"])
    want = partials.blocks(df, ["symbol"], "day_date")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
