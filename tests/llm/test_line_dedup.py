import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import common
from strata.llm import line_dedup as ld

from .conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=6), st.lists(st.sampled_from("ab"), max_size=6))
def test_near_is_edit_distance(a, b):
    assert ld.near(a, b) == (distance(a, b) <= 1)


def variants(lines, words, least):
    of, role, key = lines.variants([words], least)
    assert not of.any()
    return [*zip(role.tolist(), key.tolist(), strict=True)]


def halves(lines, words, least):
    sizes, keys = lines.halves([words], least)
    assert sizes.tolist() == [len(keys)]
    return keys.tolist()


def meet(a, b):
    partner = {ld.SAME: ld.SAME, ld.WHOLE: ld.LESS, ld.LESS: ld.WHOLE}
    return bool({(partner[role], key) for role, key in a} & {*b})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=7), st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=7))
def test_keys_meet_just_for_near_lines(a, b):
    lines, near = ld.Lines(), distance(a, b) <= 1 and a != b
    if a != b:
        assert meet(variants(lines, a, 1), variants(lines, b, 1)) == near
        if near and min(len(a), len(b)) >= 2:
            assert {*halves(lines, a, 2)} & {*halves(lines, b, 2)}


def brute(rows, least):
    order = [(i, j, tuple(line.encode().lower().split())) for i, t in sorted(rows) for j, line in enumerate((t or "").split("\n"))]
    first, exact, distinct, near = {}, set(), [], set()
    for i, j, w in order:
        if w and first.setdefault(w, (i, j)) != (i, j):
            exact.add((i, j))
        elif w:
            distinct.append((i, j, w))
    for n, (i, j, w) in enumerate(distinct):
        if len(w) >= least and any(len(v) >= least and abs(len(v) - len(w)) <= 1 and distance(v, w) <= 1 for _, _, v in distinct[:n]):
            near.add((i, j))
    return exact, near


def found(df):
    rows = df.collect()
    return {(r.doc_id, r.line_no) for r in rows if r.kind == "exact"}, {(r.doc_id, r.line_no) for r in rows if r.kind == "near"}


def test_lines_as_by_all_pairs(docs):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    lines = [[word() for _ in range(rng.choice([1, 3, 7, 8, 9, 20, 60]))] for _ in range(60)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(lines))
            at = rng.randrange(len(line))
            match rng.randrange(5):
                case 0:
                    line[at] = word()
                case 1:
                    line.insert(at, word())
                case 2:
                    del line[at]
                case 3:
                    line = [x.upper() for x in line]
            out.append("  ".join(line))
        rows.append((i, "\n".join(out)))
    assert found(ld.duplicate_lines(docs(rows))) == brute(rows, ld.MIN_WORDS)


def test_table_as_by_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found(ld.duplicate_lines(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], ld.MIN_WORDS)


def test_texts_that_are_left(docs, clashing):
    long = "one two three four five six seven eight nine"
    rows = [(3, f"{long}\nshort\n\nshort"), (1, f"Short\n{long} ten"), (None, "short"), (7, long.upper()), (8, "a b"), (9, "a c"), (10, None), (11, ""), (12, "\n")]
    for make in (docs, clashing):
        out = ld.dedup_lines(make(rows))
        got = {r.doc_id: (r.text, r.n_lines_dropped, r.n_lines_near, r.n_lines_kept) for r in out.collect()}
        assert got == {3: ("", 3, 1, 0), 1: (f"Short\n{long} ten", 0, 0, 2), None: ("short", 0, 0, 1), 7: ("", 1, 0, 0), 8: ("a b", 0, 0, 1), 9: ("a c", 0, 0, 1), 10: (None, 0, 0, 0), 11: ("", 0, 0, 0), 12: ("\n", 0, 0, 0)}


def test_odd_texts(docs):
    out = ld.dedup_lines(docs([*enumerate(ODD), (2, "twice"), (2, "twice")]))
    assert out.count() == len(ODD) + 2
    assert {r.text for r in out.where("doc_id = 2").collect()} == {" ", "twice"}
    assert ld.dedup_lines(docs([])).count() == 0


@pytest.mark.parametrize("n", [4096, 5000])
def test_long_lines(n):
    a = [b"w%d" % i for i in range(n)]
    b = a[:-1] + [b"other"]
    lines = ld.Lines()
    assert meet(variants(lines, a, 8), variants(lines, b, 8)) and {*halves(lines, a, 8)} & {*halves(lines, b, 8)}


def test_lines_together_as_alone():
    rng = random.Random(6)
    some = [[b"w%d" % rng.randrange(9) for _ in range(rng.choice([1, 2, 7, 8, 9, 30]))] for _ in range(50)]
    lines = ld.Lines()
    sizes, keys = lines.halves(some, 8)
    of, role, key = lines.variants(some, 8)
    at = 0
    for i, words in enumerate(some):
        assert keys[at : at + sizes[i]].tolist() == halves(lines, words, 8)
        at += sizes[i]
        assert sorted(zip(role[of == i].tolist(), key[of == i].tolist(), strict=True)) == sorted(variants(lines, words, 8))


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_of_one_id(docs, monkeypatch, limit):
    """Rows of an id with unlike texts are documents of their own; equal rows are one. In broadcast and in shuffled joins."""
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    out = ld.dedup_lines(docs([(1, "alpha\nbeta"), (2, "gamma\nbeta"), (2, "delta\nunique words here"), (3, "alpha\nmore"), (3, "alpha\nmore")]))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "alpha\nbeta"), (2, "delta\nunique words here"), (2, "gamma"), (3, "more"), (3, "more")]
