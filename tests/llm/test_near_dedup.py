import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import common
from strata.llm import near_dedup as nd

from .conftest import ODD


def brute(rows):
    """doc_id -> smallest id of its group, by all pairs."""
    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    bags = {i: bag(t.encode().split()) for i, t in rows if t and t.encode().split()}
    group = {i: i for i, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {i: top(i) for i, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def texts():
    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for n in (5, 8, 40, 150, 150, 400):
        base = fresh(n)
        rows += [base, base] + [edited(rng, base, k) for k in (1, 1, 2, 3, 5, 8)]
    chain = fresh(120)  # each is near the one before, the last is far from the first
    for _ in range(12):
        chain = edited(rng, chain, 1)
        rows.append(chain)
    hub = fresh(150)
    rows += [edited(rng, hub, rng.randrange(0, 8)) for _ in range(60)]
    rows += [fresh(60) for _ in range(30)]
    rows.append(["x"] * 200 + fresh(20))
    rows.append(["x"] * 230 + fresh(20))
    return [" ".join(r) for r in rows]


def test_groups_as_by_all_pairs(docs):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_table_as_by_all_pairs(spark, data):
    from strata.llm.queries import op1_near_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in op1_near_dedup(spark, data).collect()}
    assert got == brute(rows)


def test_odd_texts(docs, clashing):
    same = "one two three four five six seven"
    rows = [*enumerate(ODD), (100, same), (101, same + "\n"), (None, same), (None, None), (100, same)]
    for make in (docs, clashing):
        out = nd.near_duplicates(make(rows))
        got = [(r.doc_id, r.class_id) for r in out.collect()]
        assert sorted(map(str, got)) == sorted(map(str, [*((i, i) for i in range(len(ODD))), (100, 100), (101, 100), (None, None), (None, None), (100, 100)]))
    assert nd.near_duplicates(docs([])).count() == 0
    kept = nd.keep_one(docs(rows))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*range(len(ODD)), 100, 100, None, None]))


@pytest.mark.parametrize("seed", range(3))
def test_signatures_are_unbiased(seed):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    a = rng.integers(1, 12, len(keys))
    b = np.maximum(1, a + rng.integers(-3, 4, len(keys)))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = []
    for s in range(150):
        salted = nd.mixed(keys + np.uint64(s * 1009 + 1))
        one, two = nd.signatures([(salted, a), (salted, b)])
        same.append((one == two).mean())
    assert abs(np.mean(same) - want) < 4 * np.sqrt(want * (1 - want) / (150 * nd.REGISTERS))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=20, unique_by=lambda x: x[0]))
def test_a_signature_is_of_its_bag_alone(items):
    k = np.array(sorted(x for x, _ in items), np.uint64)
    c = np.array([dict(items)[int(x)] for x in k])
    alone = nd.signatures([(k, c)])[0]
    other = (np.arange(100, 160, dtype=np.uint64), np.full(60, 3))
    assert (nd.signatures([other, (k, c)])[1] == alone).all()


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_of_one_id(docs, monkeypatch, limit):
    """Rows of an id with unlike texts are judged each by its own, in broadcast and in shuffled joins; equal rows are one."""
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    one, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = one + " more"
    rows = [(1, one), (2, near), (2, other), (3, third), (3, third), (4, third + " and"), (5, other)]
    got = sorted((r.doc_id, r.class_id) for r in nd.near_duplicates(docs(rows)).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 3), (3, 3), (4, 3), (5, 2)]
    assert sorted((r.doc_id, r.text) for r in nd.keep_one(docs(rows)).collect()) == sorted([(1, one), (2, other), (3, third), (3, third)])
