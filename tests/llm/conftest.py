import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents from texts, or (doc_id, text) pairs, with columns whose names clash with those of results."""
    def make(rows, **more):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, more.get("lang", "en"), more.get("source", "s"), 0) for i, t in pairs]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """Documents with extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    def make(rows):
        names = ("node", "key", "group", "bands", "hash", "n", "size", "labels", "ids", "n_tokens", "line_no", "score", "bucket", "quality_score", "n_lines_kept", "taken", "target", "a", "b", "fold", "y", "word", "value")
        return docs(rows).withColumns({n: F.lit(f"x{n}") for n in names})

    return make


ODD = [None, "", " ", "\n\n", "\t \n", "a", "é", "😀 \x00 b", "word " * 30_000, "x" * 100_000]
