"""Token counts by field or section: documents are encoded once and tokens attributed by their character offsets."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import public_vocabulary, vocabulary
from strata.llm.common import map_rows, texts

RULES = ("majority", "first", "last")


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections that are lines, each with the newline that ends it; a text without characters has none."""
    ends = np.array([m.end() for m in re.finditer("\n", text)], np.int64)
    if text and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section (sorted, not overlapping) of each token, -1 for none.

    Interval join by binary search. A token inside one section is that section's. Of those that it crosses, `majority`
    gives it to the one with most of its characters (ties: the earlier), `first` and `last` to the first or last.
    """
    if not len(lo):
        return np.full(len(starts), -1)
    first = np.searchsorted(hi, starts, "right")  # first section that ends after the token starts
    last = np.searchsorted(lo, ends, "left") - 1  # last section that starts before the token ends
    out = np.where(first <= last, last if rule == "last" else first, -1)
    if rule == "majority":
        for i in np.flatnonzero(first < last):
            inside = range(first[i], last[i] + 1)
            out[i] = max(inside, key=lambda s: (min(ends[i], hi[s]) - max(starts[i], lo[s]), -s))
    return out


def count_tokens(docs: DataFrame, spans: DataFrame | None = None, rule: str = "majority", path: str | None = None) -> DataFrame:
    """doc_id, section, first_char, end_char, n_tokens for each section of each document; n_tokens of section -1 are those
    of no section (a row only if there are some).

    docs: doc_id, text; other columns are ignored. spans: doc_id, first_char, end_char (characters of the text, ends
    excluded) of fields; those of a document are numbered in order and must not overlap (an error is raised if they do);
    null or empty spans are ignored, documents without spans have section -1 alone. By default sections are lines. Texts are
    encoded whole, however long. A null or empty text has no section and no row; repeated rows, also of null id, give
    repeated rows (which have no spans of their own if the id is null); an empty table gives an empty one. rule: see attribute.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or public_vocabulary()
    rows, by_line = texts(docs), spans is None
    if not by_line:
        valid = spans.where("first_char is not null and end_char > first_char").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_char", "end_char"))).alias("spans"))
        rows = rows.join(valid, "doc_id", "left")

    def make():
        pairs = vocabulary(path)

        def handle(batch):
            for doc, text, own in zip(batch["doc_id"], batch["text"], batch.get("spans", [()] * len(batch["doc_id"])), strict=True):
                lo, hi = lines_of(text) if by_line else np.array([(s["first_char"], s["end_char"]) for s in own or []], np.int64).reshape(-1, 2).T
                if (lo[1:] < hi[:-1]).any():
                    raise ValueError(f"spans of document {doc} overlap")
                starts, ends = pairs.spans(text, pairs.encode(text))
                at = attribute(starts, ends, lo, hi, rule)
                n = np.bincount(at + 1, minlength=len(lo) + 1).tolist()
                if n[0]:
                    yield doc, -1, None, None, n[0]
                yield from zip([doc] * len(lo), range(len(lo)), lo.tolist(), hi.tolist(), n[1:], strict=True)
        return handle

    return map_rows(rows, make, "doc_id long, section long, first_char long, end_char long, n_tokens long")
