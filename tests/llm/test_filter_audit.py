"""The audit against applying each order to each document."""

import re
from itertools import permutations

import pytest

from strata.llm import filter_audit as fa

from .conftest import DOCS, ODD

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def brute(rows, labels):
    docs = []
    for i, text, _, source, *_ in rows:
        text = text or ""
        e = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        docs.append((source or "", fails(text) | ({"E"} if e else set()), any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, removed_by = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def long(i):
    return " ".join(f"w{i}x{j}" for j in range(60))


@pytest.mark.parametrize("limit", [None, 0])
def test_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(fa, "TOGETHER", 2)  # hot texts are dealt over many tasks
    texts = [*ODD, long(1), long(1), long(1), long(1).upper(), long(2) + " $", long(2) + " $", "a " * 60, long(3), long(3), "A" * 30, "é É", long(4).replace("w", "W")]
    rows = [(i, t, "en", ["s", "t", None, ""][i % 4], 0) for i, t in enumerate(texts)]
    rows += [(3, long(1), "en", "s", 0), (3, long(1), "en", "t", 0), (3, long(1), "en", "s", 0), (None, long(1), "en", "s", 0), (None, None, "en", "u", 0), (900, "", "en", "v", 0)]  # repeated and null ids
    rows += [(1000 + i, long(9), "en", "hot", 0) for i in range(20)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30)] + [(3, 1, 1), (12, None, 1), (None, 1, 1), (5000, 1, 1), (1003, 1, 0)]
    labels = [(a, b, int(c) if c is not None else None) for a, b, c in labels]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' part", "1 bits", "2 n", "3 hash", "4 deal", "'5' seen")
    got = found(fa.audit(docs, spark.createDataFrame(labels, LABELS), limit))
    assert got == brute(rows, labels) and len(got) == 600 * 6


def test_the_table(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert found(fa.audit(docs, labels)) == brute(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert fa.audit(docs([]), none).count() == 0
    got = found(fa.audit(docs(["x"]), none))
    assert len(got) == 600 and all(v[4:6] == (0, 0) for v in got.values())
