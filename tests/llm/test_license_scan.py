import random
import re

from strata.llm import license_scan as ls
from strata.llm.queries import op4_licenses

from .conftest import ODD

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def check(df, texts):
    for r in df.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id][:200]
        assert {*filter(None, r.base_labels.split(","))} <= {*filter(None, r.labels.split(","))} and 0 <= r.score <= 1


def test_whole_table(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = op4_licenses(spark, data)
    assert out.count() == len(texts)
    check(out, texts)


NOTICES = [
    "Released under the MIT License.", "MIT license MIT License mit-LICENSE", "mit é license", "K MIT Kicense", "MIT LİCENSE", "the Apache License, Version 2.0",
    "GNU General Public License, version 3 or General Public\nLicense", "Licensed under CC BY-NC 4.0.", "all mit. License general general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and all its associated documentation files",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms are allowed", "license " * 5000 + "mit license",
]


def test_notices(spark, docs, clashing, tmp_path):
    texts = dict(enumerate([*NOTICES, *ODD]))
    for n, make in enumerate((docs, clashing)):
        make(list(texts.items())).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        out = op4_licenses(spark, f"{tmp_path}/{n}")
        check(out, texts)
        labels = {r.doc_id: r.labels for r in out.collect()}
        assert [labels[i] for i in (0, 5, 6, 7, 9, 10, 11)] == ["mit", "apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "", "mit", ""]


def by_hand(words, templates, idf):
    """Labels, base places and score, trying each template at each place of the file without an index."""
    labels, base, score = set(), [], 0.0
    for t in templates:
        own = ls.split_words(t.text)
        slack, keys = t.slack(len(own)), [ls.split_words(k) for k in t.keys]
        at = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in keys]
        rare = sorted({x for x in own if x in words}, key=lambda x: (-idf[x], x))
        rare = rare if t.base else rare[: ls.LOOK]
        enough = len(rare) if t.base else (len(rare) + 1) / 2
        for place in range(len(words)):
            if words[place : place + len(keys[0])] != keys[0]:
                continue
            o = place - at[0]
            around = range(-slack, slack + 1)
            agree = sum(any(0 <= o + e + q < len(words) and words[o + e + q] == x for e in around for q in range(len(own)) if own[q] == x) for x in rare)
            if int(agree) < int(enough) or not all(any(o + e + a >= 0 and words[o + e + a : o + e + a + len(k)] == k for e in around) for k, a in zip(keys, at, strict=True)):
                continue
            labels.add(t.label)
            base += [place] * t.base
            left, found = max(0, o - slack), 0
            for i, x in enumerate(own):
                part = words[left : left + slack + 1 if found else max(0, o + i) + slack + 1]
                if x in part:
                    left, found = left + part.index(x) + 1, found + 1
            score = max(score, found / len(own) * found / (found + ls.EVIDENCE))
    return sorted(labels), sorted(base), score


def test_labels_and_scores_by_hand(docs):
    """Whole licences and notices with words replaced, dropped, put in and moved, against a scan without an index."""
    rng = random.Random(3)
    templates = ls.BASE + ls.NOTICES
    rows = []
    for i in range(150):
        words = ["text", "license", "software", "the"] * rng.randrange(4)
        for t in rng.sample(templates, rng.randrange(1, 4)):
            own = t.text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 6, 20])):
                p = rng.randrange(len(own))
                own[p : p + rng.randrange(2)] = rng.choice([[], ["x"], ["the"], ["License"], ["y"] * rng.randrange(12)])
                own = own or ["none"]
            words += own + ["z"] * rng.randrange(6)
        rows.append((i, " ".join(words)))
    table = docs(rows)
    idf = ls.document_frequencies(table, ls.Index(templates).vocabulary)
    got = {r.doc_id: (r.labels, r.base_places, r.score) for r in ls.scan_licenses(table).collect()}
    want = {i: by_hand(ls.split_words(t), templates, idf) for i, t in rows}
    assert got == want
    assert len({tuple(x) for x, _, _ in want.values()}) > 30 and any(0 < s < 1 for *_, s in want.values())


def test_the_table_by_hand(spark, data):
    """Labels, places and scores of all documents, against the scan without an index."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    idf = ls.document_frequencies(docs, ls.Index(ls.BASE + ls.NOTICES).vocabulary)
    got = {r.doc_id: (r.labels, r.base_places, r.score) for r in ls.scan_licenses(docs).collect()}
    want = {r.doc_id: by_hand(ls.split_words(r.text or ""), ls.BASE + ls.NOTICES, idf) for r in docs.collect()}
    assert got == want and len({s for *_, s in want.values()}) > 2


def test_a_name_counts_for_less_than_a_text(docs):
    whole = next(t.text for t in ls.NOTICES if len(t.text) > 900)
    got = {r.doc_id: r.score for r in ls.scan_licenses(docs(["mit license", whole, "none"])).collect()}
    assert 0 == got[2] < got[0] < 0.3 < 0.9 < got[1]


def test_edge_rows(docs):
    out = ls.scan_licenses(docs([(None, "mit license"), (1, "mit license"), (1, "mit license")]))
    assert sorted((str(r.doc_id), r.base_places) for r in out.collect()) == [("1", [0]), ("1", [0]), ("None", [0])]
    assert ls.scan_licenses(docs([])).count() == 0
