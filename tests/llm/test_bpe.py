import hashlib
import random

import numpy as np
import pytest

from strata.llm import bpe

from .conftest import ODD


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs(bpe.public_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_vocabulary())


def ids(pairs, text):
    return np.frombuffer(pairs.encode(text), "<u4").tolist()


def wanted(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_documents_as_the_library(pairs, library, spark, data):
    for (text,) in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert ids(pairs, text) == wanted(library, text)
        assert pairs.decode(pairs.encode(text)) == library.decode(wanted(library, text), skip_special_tokens=False) == text


def test_every_character(pairs, library):
    for base in range(0, 0x110000, 512):
        text = "".join(f"a{c}1{c} {c}b {c}{c}  {c}\n" for c in map(chr, range(base, base + 512)) if not 0xD800 <= ord(c) < 0xE000)
        if text:
            assert ids(pairs, text) == wanted(library, text)


def test_random_mixtures(pairs, library):
    random.seed(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "1", "2345", "!", "<|endoftext|>", "<|endof", "aaaaaaaa", "the", "ing", "日本", " ", "\x1c", "\x85", "😀", "http://"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert ids(pairs, text) == wanted(library, text), text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=" * 999 + "!" * 1000, " " * 500, "\n" * 501, "Zm9vYmFy" * 5000])
def test_long_pretokens(pairs, library, text):
    assert ids(pairs, text) == wanted(library, text)


def test_odd_texts(docs, library, clashing):
    for make in (docs, clashing):
        got = {r.doc_id: r for r in bpe.round_trip(make(ODD)).collect()}
        assert len(got) == len(ODD)
        for i, text in enumerate(ODD):
            want = wanted(library, text or "")
            assert got[i].n_tokens == len(want)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode(docs):
    texts = ["The end.<|endoftext|>", None, "ñandú \n\n x", "same", "same"]
    rows = docs([(i // 2 if i else None, t) for i, t in enumerate(texts)])
    encoded = bpe.encode_documents(rows)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode_documents(encoded).collect())
    assert back == sorted((str(i // 2 if i else None), t or "") for i, t in enumerate(texts))
    assert bpe.encode_documents(docs([])).count() == 0
