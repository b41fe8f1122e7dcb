import corpus_pipeline as cp
from strata.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from strata.llm.common import table

from .conftest import DOCS, ODD


def test_stages_against_their_operators(spark, data):
    docs = table(spark, data, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding"]
    columns = docs.columns
    accepted = {r.doc_id for r in quality_classifier.classify(docs, table(spark, data, "labels")).where("quality_predicted = 1").collect()}
    docs = cp.materialise(cp.quality(spark, docs, data))
    assert {r.doc_id for r in docs.collect()} == accepted and docs.columns == columns
    drops = {}
    for r in line_dedup.duplicate_lines(docs, per=line_dedup.PER).collect():
        drops.setdefault(r.doc_id, set()).add(r.line_no)
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in drops.get(r.doc_id, ())) for r in docs.collect()}
    docs = cp.materialise(cp.distinct_lines(spark, docs, data))
    assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in want.items() if t.split() or i not in drops} and docs.columns == columns
    firsts = {r.doc_id for r in near_dedup.near_duplicates(docs).where("doc_id = class_id").collect()}
    docs = cp.materialise(cp.distinct_documents(spark, docs, data))
    assert {r.doc_id for r in docs.collect()} == firsts and docs.columns == columns
    copies = {r.doc_id: r.epochs + r.drawn for r in mixing.mix(docs).collect()}
    docs = cp.materialise(cp.mixture(spark, docs, data))
    assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n} and docs.columns == columns
    pairs = bpe.BytePairs(bpe.public_vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = cp.tokens(spark, docs, data).collect()
    assert len(out) == sum(copies.values())
    assert all(b"".join(pairs.bytes[i] for i in r.ids).decode() == texts[r.doc_id] and len(r.ids) == r.n_tokens for r in out)
    whole = cp.run(spark, data).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole) == sorted((r.doc_id, tuple(r.ids)) for r in out)


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_edge_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, null sources: every stage gives a defined result."""
    prose = [" ".join(f"word{i}x{j}" for j in range(40)) + f"\nline {i} of some five words" for i in range(12)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*ODD, *prose])]
    rows += [rows[12], rows[12], (None, prose[0], "en", "s", 0), (None, prose[0], None, None, 0), (50, prose[3], "en", None, 0), (12, prose[5], "en", "s", 0)]
    data = write(spark, tmp_path, rows, [(i, int(i > 9), 0) for i in range(22)] + [(None, 1, 0), (12, None, 0)])
    docs, seen = table(spark, data, "documents"), []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialise(stage(spark, docs, data))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    judged, lines, documents, mixed = seen
    assert {*judged} <= {(r[0], r[1]) for r in rows} and judged
    # rows without an id pass both deduplications as they are
    assert [t for i, t in documents if i is None] == [t for i, t in judged if i is None]
    assert {*documents} <= {*lines} and {*mixed} <= {*documents}
    out = cp.run(spark, data).collect()
    assert len(out) == len(mixed) and all(len(r.ids) == r.n_tokens for r in out)


def test_empty_table(spark, tmp_path):
    assert cp.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_lines_of_a_large_group_do_not_all_meet(spark, docs, monkeypatch):
    """60 lines differ from one in 5 words each, beyond the bound of each other; one more is near one of them."""
    base = [f"w{i}" for i in range(60)]
    some = [[f"x{i}-{j}" if (j - 7 * i) % 12 == 0 else w for j, w in enumerate(base)] for i in range(60)]
    some.append([*some[30][:58], "the", "end"])
    far_pairs, most = line_dedup.far_pairs, []

    def far(met, first, per):
        most.append(max((r["count"] for r in met.groupBy("key").count().collect()), default=0))
        return far_pairs(met, first, per)

    monkeypatch.setattr(line_dedup, "FEW", 8, raising=False)
    monkeypatch.setattr(line_dedup, "far_pairs", far)
    left = cp.distinct_lines(spark, docs([" ".join(x) for x in some]), "")
    assert {r.doc_id for r in left.collect()} == {*range(60)} and most[0] > 8 >= most[1]
