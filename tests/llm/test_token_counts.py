import pytest

from strata.llm import bpe, token_counts

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_vocabulary())


def brute(library, text, spans, rule):
    counts = {}
    for lo, hi in library.encode(text, add_special_tokens=False).offsets:
        inside = [(s, min(hi, b) - max(lo, a)) for s, (a, b) in enumerate(spans) if min(hi, b) > max(lo, a)]
        at = -1 if not inside else inside[0][0] if rule == "first" else inside[-1][0] if rule == "last" else max(inside, key=lambda x: (x[1], -x[0]))[0]
        counts[at] = counts.get(at, 0) + 1
    return {s: counts.get(s, 0) for s in [*range(len(spans)), *([-1] if -1 in counts else [])]}


def lines(text):
    out, at = [], 0
    for part in text.split("\n"):
        out.append((at, min(len(text), at + len(part) + 1)))
        at += len(part) + 1
    return [x for x in out if x[0] < x[1]]


def test_lines(docs, clashing, library):
    texts = [*ODD, "One.\n\n\nTwo\n  three", "ñandú 日本\n日", "\nx", "a\r\nb\rc\r\n", "\x00\n\x00a\n"]
    for make in (docs, clashing):
        got = {}
        for r in token_counts.count_tokens(make(texts)).collect():
            got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
        for i, t in enumerate(texts):
            assert got.get(i, {}) == brute(library, t or "", lines(t or ""), "majority"), t


def test_table(spark, data, library):
    """Each line of each document of the table, by the library's offsets and all lines that a token meets."""
    from strata.llm.queries import op7_token_counts

    got = {}
    for r in op7_token_counts(spark, data).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert got.get(r.doc_id, {}) == brute(library, r.text, lines(r.text), "majority"), r.doc_id


def test_repeated_rows_and_null_ids(docs, library):
    rows = token_counts.count_tokens(docs([(1, "a b\nc"), (1, "a b\nc"), (None, "a b\nc")])).collect()
    want = brute(library, "a b\nc", lines("a b\nc"), "majority")
    assert sorted((str(r.doc_id), r.section, r.n_tokens) for r in rows) == sorted((i, s, n) for i in ("1", "1", "None") for s, n in want.items())


def test_spans_must_not_overlap(spark, docs):
    spans = spark.createDataFrame([(0, 0, 3), (0, 2, 4)], "doc_id long, first_char long, end_char long")
    with pytest.raises(Exception, match="overlap"):
        token_counts.count_tokens(docs(["abcdef"]), spans).collect()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_fields(spark, docs, library, rule):
    text = "Title of it: a ñandú\n\n\n\n\n\nBody text here, 日本 and unbelievable things"
    spans = [(0, 7), (7, 9), (12, 22), (24, 40), (41, 60)]
    fields = spark.createDataFrame([(0, a, b) for a, b in reversed(spans)] + [(0, 5, 5), (0, None, 3), (9, 0, 4)], "doc_id long, first_char long, end_char long")
    out = token_counts.count_tokens(docs([text, "no fields"]), fields, rule)
    got = {r.section: r.n_tokens for r in out.where("doc_id = 0").collect()}
    assert got == brute(library, text, spans, rule)
    assert [(r.section, r.n_tokens) for r in out.where("doc_id = 1").collect()] == [(-1, len(library.encode("no fields").ids))]
    assert token_counts.count_tokens(docs([]), fields).count() == 0


def test_all_tokens_are_counted(spark, data):
    from strata.llm.queries import op3_bpe, op7_token_counts

    per = {r.doc_id: r["sum(n_tokens)"] for r in op7_token_counts(spark, data).groupBy("doc_id").sum("n_tokens").collect()}
    assert all(per.get(r.doc_id, 0) == r.n_tokens for r in op3_bpe(spark, data).collect())
