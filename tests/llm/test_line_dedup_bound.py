"""A bound that grows with the line."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm import line_dedup as ld
from strata.llm import queries

from .test_line_dedup import distance, found


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9), st.integers(0, 4))
def test_within_is_edit_distance(a, b, k):
    assert ld.within(a, b, k) == ld.within_by_columns(a, b, k) == (distance(a, b) <= k)


def test_within_is_edit_distance_of_long_lists():
    rng = random.Random(7)
    for _ in range(60):
        a = [rng.randrange(40) for _ in range(rng.randrange(130, 200))]
        b = edited(rng, a, rng.randrange(1, 14), lambda: rng.randrange(50))
        d = distance(a, b)
        assert not ld.within(a, b, d - 1) and ld.within(a, b, d) and ld.within_by_columns(a, b, d)


def edited(rng, words, edits, word):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = word()
            case 1:
                out.insert(at, word())
            case 2:
                del out[at]
    return out


@pytest.mark.parametrize("alphabet", [1, 3, 500])
def test_near_lines_share_a_key_and_masks_allow_them(alphabet):
    rng, lines, tested = random.Random(alphabet), ld.Lines(), 0
    word = lambda: b"w%d" % rng.randrange(alphabet)
    for i in range(400):
        per = rng.choice([8, 20])
        a = [word() for _ in range(rng.randrange(max(8, per - 3), 8 * per if i % 20 else 40 * per))]
        b = edited(rng, a, max(1, len(a) // per), rng.choice([word, lambda: b"new%d" % rng.randrange(9)]))
        k = max(1, min(len(a), len(b)) // per)
        if min(len(a), len(b)) >= 8 and a != b and ld.within(a, b, k):
            masks, keys = lines.keys([a, b], 8, per)
            shared = {*keys[0].as_py()} & {*keys[1].as_py()}
            assert any(x & 1 == (k > 1) for x in shared)
            assert sum(((int(m[0]) ^ int(m[1])) % 2**64).bit_count() for m in masks) <= 2 * k
            tested += 1
    assert tested > 100


def test_long_lines_meet_much_shorter_ones():
    """The bounds of 500 words and of 476, within the latter's, differ by two."""
    words = [b"w%d" % i for i in range(500)]
    keys = ld.Lines().keys([words, words[24:], words[12:488]], 8, 20)[1].to_pylist()
    assert {*keys[0]} & {*keys[1]} and {*keys[0]} & {*keys[2]}


def test_lines_that_share_a_passage_hardly_share_class_keys():
    passage = [b"p%d" % i for i in range(50)]
    rows = [[b"%d-%d" % (i, j) for j in range(30)] + passage for i in range(50)]
    keys = [{x for x in k if x & 1} for k in ld.Lines().keys(rows, 8, 20)[1].to_pylist()]
    assert sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i]) < 25  # of 1225 pairs


def brute(rows, per, every=False):
    """Places of lines within one word of any earlier line, or within a larger bound of the earliest line of one of their keys
    (every: of any earlier line)."""
    first = {}
    for i, text in sorted(rows):
        for j, line in enumerate(text.split("\n")):
            first.setdefault(tuple(line.split()), (i, j))
    some = [*first.items()]
    keys = [{*k} for k in ld.Lines().keys([[x.encode() for x in w] for w, _ in some], ld.MIN_WORDS, per)[1].to_pylist()]
    earliest = {}
    for n, own in enumerate(keys):
        for k in own:
            earliest.setdefault(k, n)
    near = set()
    for n, (w, place) in enumerate(some):
        met = {earliest[k] for k in keys[n] if k & 1}
        for m, (v, _) in enumerate(some[:n]):
            k = max(1, min(len(v), len(w)) // per)
            if min(len(v), len(w)) >= ld.MIN_WORDS and abs(len(v) - len(w)) <= k and distance(v, w) <= (k if every or m in met else 1):
                near.add(place)
                break
    return near


def test_lines_as_by_all_pairs(docs, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(900)}"
    bases = [[word() for _ in range(rng.choice([8, 20, 39, 40, 41, 60, 100]))] for _ in range(12)]
    rows = [(i, "\n".join(" ".join(edited(rng, w, rng.randrange(len(w) // 20 + 3), word)) for w in rng.choices(bases, k=3))) for i in range(40)]
    near, every, small = brute(rows, 20), brute(rows, 20, every=True), brute(rows, 10**9)
    assert small < near <= every and len(near) >= 0.8 * len(every)  # all of these lines lie about their bound
    assert found(ld.duplicate_lines(docs(rows), per=20))[1] == near
    assert found(ld.duplicate_lines(docs(rows)))[1] == small
    assert found(ld.duplicate_lines(docs(rows), per=20, rounds=None))[1] == every
    assert near <= found(ld.duplicate_lines(docs(rows), per=20, rounds=2))[1] <= every
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)  # all joins are shuffled
    assert found(ld.duplicate_lines(docs(rows), per=20))[1] == near


def test_few_lines_of_the_table_are_near_later_holders_only(spark, data):
    """Against all pairs of lines: no more, and hardly fewer."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = {}
    for r in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        for j, line in enumerate(r[1].split("\n")):
            if words := tuple(line.encode().lower().split()):
                first.setdefault(words, (r[0], j))
    some, every = [*first.items()], set()
    for n, (w, place) in enumerate(some):
        for v, _ in some[:n]:
            k = max(1, min(len(v), len(w)) // ld.PER)
            if min(len(v), len(w)) >= ld.MIN_WORDS and abs(len(v) - len(w)) <= k and ld.within(v, w, k):
                every.add(place)
                break
    near = found(ld.duplicate_lines(docs, per=ld.PER))[1]
    assert near <= every and len(near) >= 0.95 * len(every) and every
    assert found(ld.duplicate_lines(docs, per=ld.PER, rounds=None))[1] == every


def test_short_lines(docs):
    """One word of five may differ, one of four may not."""
    rows = ["a b c d e\nf g h i", "a b x d e\nf g h j", "a b c d"]
    assert found(ld.duplicate_lines(docs(rows)))[1] == {(1, 0)}


def test_query_has_the_growing_bound(spark, tmp_path):
    a = [f"w{i}" for i in range(60)]
    b, c = [*a[:10], "x", *a[12:50], "y", *a[50:]], ["x", "y", "z", "v", *a[4:]]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((a, b, c))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_lines_near for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0}


def test_query_and_pipeline_find_lines_near_a_later_holder_only(spark, tmp_path):
    """The second line is beyond the bound of the first. The third is within that of the second, but each class key that it
    shares with the second is the first's too."""
    import corpus_pipeline

    rng, base = random.Random(3), [f"w{i}" for i in range(60)]
    for n in range(100_000):
        x, changed = list(base), rng.sample(range(60), 4)
        for at in changed:
            x[at] = f"x{n}-{at}"
        y = [*x]
        for at in changed[1:]:
            y[at] = f"y{n}-{at}"
        keys = [{k for k in own if k & 1} for own in ld.Lines().keys([[w.encode() for w in line] for line in (base, x, y)], ld.MIN_WORDS, ld.PER)[1].to_pylist()]
        if keys[1] & keys[2] <= keys[0]:
            break
    rows = [*enumerate(" ".join(line) for line in (base, x, y))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert not brute(rows, ld.PER) and not found(ld.duplicate_lines(docs, per=ld.PER))[1]
    assert {r.doc_id: r.n_lines_near for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 0, 2: 1}
    assert {r.doc_id for r in corpus_pipeline.distinct_lines(spark, docs, str(tmp_path)).collect()} == {0, 1}


def by_all_pairs(rows, per):
    """Places of the rows (doc_id, a line) that are within their bound of an earlier one."""
    some = [(i, [x.encode() for x in line.split()]) for i, line in rows]
    return {(i, 0) for n, (i, w) in enumerate(some) if any(abs(len(v) - len(w)) <= (k := max(1, min(len(v), len(w)) // per)) and ld.within(v, w, k) for _, v in some[:n])}


def test_lines_that_differ_each_in_its_own_way_do_not_all_meet(docs, monkeypatch):
    """Not even before their lengths and masks are looked at."""
    rng, base, rows = random.Random(9), [f"w{i}" for i in range(60)], []
    for i in range(300):
        line = rows[i - 100][1].split() if i % 50 == 49 and i > 100 else [*base]
        for at in rng.sample(range(60), 2 if line != base else 5):
            line[at] = f"x{i}-{at}"
        rows.append((i, " ".join(line)))
    far_pairs, verified, most, tried = ld.far_pairs, ld.verified, [], []

    def far(met, first, per):
        most.append(met.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return far_pairs(met, first, per)

    def counted(pairs, some, test):
        tried.append(pairs.count())
        return verified(pairs, some, test)

    monkeypatch.setattr(ld, "FEW", 0, raising=False)
    monkeypatch.setattr(ld, "may_be_near", lambda *_: F.lit(True), raising=False)
    monkeypatch.setattr(ld, "far_pairs", far)
    monkeypatch.setattr(ld, "verified", counted)
    near = found(ld.duplicate_lines(docs(rows), per=20, rounds=None))[1]
    assert near == by_all_pairs(rows, 20) == {(149, 0), (199, 0), (249, 0), (299, 0)}
    assert most[0] > 50 and most[1:] == [0] and tried[-1] < 30


@pytest.mark.parametrize("few", [0, 3])
def test_large_groups_as_by_all_pairs(docs, monkeypatch, few):
    """Also lines of one word over and over with some of their own, of the same words in other orders, and about their bound."""
    rng, rows = random.Random(6), set()
    word = lambda: f"w{rng.randrange(900)}"
    for n in (40, 60, 61, 100):
        base = [word() for _ in range(n)]
        for _ in range(25):
            line = edited(rng, base, rng.randrange(2 * n // 20 + 3), word)
            at = rng.randrange(len(line))
            rows |= {" ".join(line), " ".join(line[at:] + line[:at])}
    for _ in range(40):
        line = ["x"] * rng.randrange(290, 310) + [word() for _ in range(rng.randrange(8, 24))]
        rng.shuffle(line)
        rows.add(" ".join(line))
        rows.add(" ".join(sorted(line)))
    rows = [*enumerate(rng.sample(sorted(rows), len(rows)))]
    monkeypatch.setattr(ld, "FEW", few, raising=False)
    every = by_all_pairs(rows, 20)
    assert found(ld.duplicate_lines(docs(rows), per=20))[1] < every
    assert found(ld.duplicate_lines(docs(rows), per=20, rounds=None))[1] == every
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)  # all joins are shuffled
    assert found(ld.duplicate_lines(docs(rows), per=20, rounds=None))[1] == every


def test_lines_of_few_words_share_class_keys_just_if_like():
    """Words that repeat are numbered: no class is empty in both of two lines, and masks see words that repeat evenly."""
    rows = [[b"%d-%d" % (i, j) for j in range(8) for _ in range(16)] for i in range(40)]
    masks, keys = ld.Lines().keys(rows, 8, 20)
    keys = [{x for x in k if x & 1} for k in keys.to_pylist()]
    assert not any(a & b for i, a in enumerate(keys) for b in keys[:i])
    assert len({tuple(int(m[i]) for m in masks) for i in range(40)}) == 40


def test_numbered_words():
    """As by counting, also where parts of hashes are alike."""
    import numpy as np

    rng = random.Random(8)
    for words in ([5, 6, 1 << 60], [*range(9)], [1]):
        n = np.array([rng.randrange(9) for _ in range(50)])
        h = np.array([rng.choice(words) for _ in range(n.sum())], np.uint64)
        got, ends = ld.numbered(n, h), np.cumsum(n)
        for size, end in zip(n.tolist(), ends.tolist(), strict=True):
            own = h[end - size : end].tolist()
            want = ld.mixed(np.array([x + own[:i].count(x) * int(ld.BASE) & (1 << 64) - 1 for i, x in enumerate(own)], np.uint64))
            assert sorted(got[end - size : end].tolist()) == sorted(want.tolist())
    assert not len(ld.numbered(np.zeros(0, int), np.zeros(0, np.uint64)))
