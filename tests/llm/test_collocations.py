"""Phrase collocations against counting all phrases, and automata against dictionaries."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import collocations as co
from strata.llm import count_automata as ca

from .conftest import DOCS, ODD

PHRASES = st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"c", b"\xc3\xa9", b"\x00"]), min_size=1, max_size=4).map(tuple), st.integers(0, 2**60), max_size=30)


@settings(max_examples=200, deadline=None)
@given(PHRASES)
def test_automata_hold_what_they_are_given(items):
    made = ca.build(sorted(items.items()))
    for a in (made, ca.Automaton.load(made.dump())):
        assert dict(a.items()) == items and [p for p, _ in a.items()] == sorted(items)
        assert all(a.get(p) == n for p, n in items.items()) and a.get((b"a", b"zz")) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(PHRASES, min_size=1, max_size=4))
def test_union_adds_and_composition_looks_up(several):
    automata = [ca.build(sorted(x.items())) for x in several]
    total = Counter()
    for x in several:
        total.update(x)
    assert [*ca.union(automata)] == sorted((p, total[p]) for p in {p for x in several for p in x})
    assert dict(ca.compose(automata[0], automata[-1])) == {p: n for p, n in several[-1].items() if p in several[0]}


def test_equal_futures_are_one_state():
    made = ca.build(sorted(((a, b), 7) for a in (b"x", b"y", b"z") for b in (b"p", b"q")))
    assert len(made.final) == 3
    with pytest.raises(ValueError):
        ca.build([((b"b",), 1), ((b"a",), 1)])


def brute(rows, longest, least, k):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in cand.items():
        lang, words = p[0], p[1:]
        inside = any(q[0] == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(words)] == words for i in range(1, len(q))) for q, b in cand.items())
        if not inside:
            score, _, l, r = min((1_000_000 * a * a // (f[p[:j]] * f[(lang, *p[j:])]), j, f[p[:j]], f[(lang, *p[j:])]) for j in range(2, len(p)))
            out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    rank, got = Counter(), set()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= k:
            got.add((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return got


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({*rows})
    return {*rows}


TEXTS = [*ODD, "the cat sat. The cat\tsat on the mat! the cat", "a a a a a a a a", "A\x0bB a,b a b;a b:c a b c\x0ca b c d", "é É the cat sat", "a\x00b a\x00b x", "the cat sat on the mat\r\nthe cat sat on the hat", "x.y. ...", " the  cat   sat on "]


def test_odd_texts_by_brute_force(spark, clashing, monkeypatch):
    monkeypatch.setattr(co, "RANGE", 9)  # many prefix ranges
    monkeypatch.setattr(co, "GROUP", 50)
    langs = ["en", None, "und", "x y/z\n", ""]
    rows = [(i if i % 4 else None, t, langs[i % len(langs)], "s", 0) for i, t in enumerate(TEXTS * 3)]
    rows += rows[5:9]  # repeated rows count each time
    docs = spark.createDataFrame(rows, DOCS)
    for longest, least, k in ((3, 3, 2000), (4, 2, 3), (2, 1, 7)):
        assert found(co.collocations(docs.withColumn("phrase", docs.text), longest, least, k)) == brute(rows, longest, least, k)


def test_the_table_by_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(co, "RANGE", 2000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = found(co.collocations(docs))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], 3, 10, 2000) and len(got) > 100


def test_nothing_to_find(spark, docs):
    for rows in ([], [None, "", " . , "], ["each word once"]):
        assert co.collocations(docs(rows)).count() == 0


def test_counts_beyond_64_bits(spark):
    """Squares of counts and their products are exact."""
    a, b, c = 3_000_000_019, 4_000_000_007, 9_000_000_001
    items = {(b"en", b"x"): b, (b"en", b"y"): c, (b"en", b"x", b"y"): a}
    ranges = spark.createDataFrame([(0, bytearray(ca.build(sorted(items.items())).dump()))], "range long, automaton binary")
    row = co.scored(ranges, co.part_counts(ranges, [])).first()
    assert (row.phrase, row.a, row.l, row.r, row.score) == ("x y", a, b, c, 1_000_000 * a * a // (b * c))


def test_the_best_are_ranked_in_parts(spark):
    rows = [("en" if i % 3 else "fr", f"p{i:03d}", i % 7 + 10, 1, 1, i % 5) for i in range(400)]
    got = sorted(map(tuple, co.top(spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, score long"), 4).collect()))
    want = []
    for lang in ("en", "fr"):
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[5], -r[2], r[1]))[:4]
        want += [(*r, i + 1) for i, r in enumerate(best)]
    assert got == sorted(want)
