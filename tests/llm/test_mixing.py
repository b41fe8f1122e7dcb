import re

import duckdb
import pytest

from strata.llm import mixing

from .conftest import DOCS, ODD


def fill(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets, by sharing again whatever goes past the stops."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        per = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=order.index):
            target[s] += per * weight[s]
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = epochs * sizes[s]
        open_ = {s for s in open_ if target[s] < epochs * sizes[s]}
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture
def table(spark):
    rows = [(i, "w " * (i * 7 % 40), "en", s, 0) for i in range(300) for s in [["b", "a", "é", None, "Z", ""][i % 6 if i % 5 else 0]]]
    rows += [(1000 + i, t, "en", "odd", 0) for i, t in enumerate(ODD)] + [(5, "w w", "en", "a", 0)] * 2 + [(None, "one two", "en", "a", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_targets_and_taken(table):
    rows = mixing.mix(table, bucket=20).collect()
    assert len(rows) == table.count()
    sizes = {}
    for r in table.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want, largest = fill(sizes), {}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(r.size, largest.get(r.source, 0))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(table.repartition(7), bucket=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_same_as_sql(spark, table, tmp_path):
    table.coalesce(1).write.parquet(f"{tmp_path}/t")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/t/*.parquet'")
    want = con.execute(mixing.MIX_SQL).fetchall()
    got = [tuple(r) for r in mixing.mix(table, bucket=20).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_copies_of_documents(table, spark):
    rows = mixing.mixed_documents(table.where("doc_id is not null"))
    assert rows.columns == table.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert all(counts.get(r.doc_id, 0) == r.epochs + r.drawn for r in mixing.mix(table.where("doc_id is not null")).collect() if r.doc_id != 5)


def test_no_python_in_the_plan(table):
    plan = mixing.mix(table)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark, docs, clashing):
    assert mixing.mix(docs([])).count() == 0
    nothing = mixing.mix(docs([None, "", " "])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 3
    assert {r.taken for r in mixing.mix(clashing(["a b"] * 8)).collect()} <= {2, 4}


def test_buckets_are_even_whatever_the_weights(spark, monkeypatch):
    """A source whose weights are nearly all the least one: no bucket of the prefix sums is much larger than wanted."""
    rows = [(i, "w " * 3, "en", "s", 0, 0.0 if i % 10 else 1.0) for i in range(4000)]
    table = spark.createDataFrame(rows, DOCS + ", score double")
    kept = []
    real = mixing.joined
    monkeypatch.setattr(mixing, "joined", lambda df, *a: kept.append(df) or real(df, *a))
    taken = {r.doc_id: r.taken for r in mixing.mix(table, bucket=100, share=0.3, quality="score").collect()}
    sizes = [r["count"] for r in kept[1].groupBy("bucket").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 160
    drawn = [sum(taken[i] > 0 for i in range(4000) if (i % 10 == 0) == good) for good in (True, False)]
    assert drawn[0] > 0.8 * 400 and drawn[1] < 0.4 * 3600  # by quality
