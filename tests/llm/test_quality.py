import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import quality_classifier as qc
from strata.llm import quality_rules as qr

from .conftest import DOCS, ODD


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def check_counts(df, texts):
    for r in df.collect():
        n = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_counts(docs, clashing):
    texts = dict(enumerate([*ODD, "a b c d e f a b c d e", "a a a a a a", "x\ny\n x\nx\n\n", "a\x0bb\x1cc d", "1 2 3 4 5 6 7 8 9 10 1 2 3 4 5"]))
    for make in (docs, clashing):
        check_counts(qr.judge(make(list(texts.items()))), texts)
    assert qr.judge(docs([])).count() == 0


def test_rules_on_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = qr.judge(docs)
    check_counts(out, texts)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in out.collect() if r.doc_id in quality]
    good = [r for r in rows if quality[r.doc_id] == 1 and not r.base_failed]
    bad = [r for r in rows if quality[r.doc_id] == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


def stats_of(text):
    """(count, of how many) of the five statistics of one text, by themselves."""
    text = text or ""
    n_words, chars, symbols, dup, repeated = counts(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    marks = sum(c < "\x80" and not c.isalnum() and c not in " \t\n\x0b\x0c\r" for c in text)
    upper = sum("A" <= c <= "Z" for c in text)
    return {"symbol_share": (symbols, chars), "mark_share": (marks, chars), "upper_share": (upper, chars), "dup_line_share": (dup, len(lines)), "repeat_share": (repeated, n_words)}


def verdicts(rows, stats, fence, prior):
    """failed of each of the rows (id, text, lang, source), by sorting all values."""
    def edge(x):
        return qr.LEAST * qr.GAMMA ** max(0, math.ceil(math.log(x / qr.LEAST) / math.log(qr.GAMMA)))

    every, out = [stats_of(r[1]) for r in rows], []
    base = [n[0] < 10 or 100 * n[4] > 20 * n[0] for n in (counts(r[1]) for r in rows)]
    known = {}

    def at(level, stat):
        """n, n above zero, q25, q75 of the sound documents of a level: (), (lang,) or (lang, source)."""
        if (level, stat) not in known:
            shares = [c / of if of else 0 for c, of in (every[j][stat] for j, o in enumerate(rows) if not base[j] and o[2 : 2 + len(level)] == level)]
            xs = sorted(edge(x) for x in shares if x > 0)
            known[level, stat] = len(shares), len(xs), *(xs[math.ceil(p * len(xs)) - 1] if xs else 0.0 for p in (0.25, 0.75))
        return known[level, stat]

    for i, r in enumerate(rows):
        failed = []
        for stat in stats:
            n, above, *q = at((), stat)
            if not above or not at(tuple(r[2:4]), stat)[0]:
                continue
            share = above / n
            for level in (tuple(r[2:3]), tuple(r[2:4])):
                n, above, *own = at(level, stat)
                share = (above + prior * share) / (n + prior)
                q = [(above * x + prior * y) / (above + prior) for x, y in zip(own, q, strict=True)]
            low, high = (min(x, qr.MOST) / (1 - min(x, qr.MOST)) for x in q)
            odds = high * (high / low) ** max(0, fence + qr.RARE * math.log10(share))
            f, (c, of) = odds / (1 + odds), every[i][stat]
            if c > f * of + qr.CHANCE * math.sqrt(of * f * (1 - f)) + 1e-9:
                failed.append(stat)
        out.append(",".join(failed))
    return out


def outcome(df):
    return sorted((str(r.doc_id), r.failed, r.kept) for r in df.collect())


def wanted(rows, *how):
    base = [n[0] < 10 or 100 * n[4] > 20 * n[0] for n in (counts(r[1]) for r in rows)]
    return sorted((str(r[0]), f, not b and not f) for r, f, b in zip(rows, verdicts(rows, *how), base, strict=True))


def test_fences_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{j}{'#' * int(rng.integers(0, 3 if s == 'a' else 1))}" for j in range(int(rng.integers(20, 60)))), lang, s, 0) for i in range(240) for lang, s in [("en", "a" if i % 3 else "b") if i % 20 else (None, "rare")]]
    rows += [(500 + i, " ".join(f"w{j}{'#' * i}" for j in range(40)), "en", "b", 0) for i in range(8)]
    rows += [rows[5], rows[5], (None, "short", None, None, 0), (900, None, "en", None, 0)]  # repeated rows, null source and id
    docs, how = spark.createDataFrame(rows, DOCS), (("symbol_share", "mark_share"), 1.0, 50)
    got = outcome(qr.judge(docs, *how))
    assert got == wanted(rows, *how) and len({f for _, f, _ in got}) > 1


def test_verdicts_of_the_table_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert outcome(qr.judge(docs)) == wanted(rows, tuple(qr.STATS), qr.FENCE, qr.PRIOR)


def thresholds_of(spark, rows, stats):
    """rows: key and a share of each statistic."""
    df = spark.createDataFrame([(k, *([x] * len(stats))) for k, x in rows], "key string, " + ", ".join(f"{s} double" for s in stats)).withColumn("lang_key", F.lit("l"))
    return {(r.key, r.stat): r for r in qr.thresholds(df, stats).collect()}


def test_a_group_does_not_jump_with_its_size(spark):
    """99 and 101 rows of a group have nearly one fence, though its language's is another."""
    def limit(n):
        rows = [("s", 0.001 + i * 1e-6) for i in range(500)] + [("t", 0.02 + 0.0001 * i) for i in range(n)]
        return thresholds_of(spark, rows, ("x",))["t", "x"].fence

    assert abs(limit(99) - limit(101)) < 0.02 * limit(100)


def test_fences_come_from_the_values(spark):
    """Ten times larger values of a group give about ten times its fence, a wider spread more; rarer values above zero less."""
    rng = np.random.default_rng(7)
    base = 0.004 * np.exp(0.2 * rng.normal(size=3000))
    rows = [("one", float(x)) for x in base] + [("ten", float(10 * x)) for x in base] + [("wide", float(0.004 * (x / 0.004) ** 2)) for x in base] + [("rare", float(x)) for x in base] + [("rare", 0.0)] * 300_00
    at = thresholds_of(spark, rows, ("x",))
    fence = {k: at[k, "x"].fence for k in ("one", "ten", "wide", "rare")}
    assert fence["rare"] < fence["one"] < fence["wide"] and 6 < fence["ten"] / fence["one"] < 12 and at["rare", "x"].above < 0.2
    assert fence["one"] > base.max()  # none of a plain spread is past it
    assert thresholds_of(spark, [("k", 0.0)] * 5, ("x",))["k", "x"].fence is None


def test_every_statistic_can_reject(spark):
    """One document of many is far beyond the others in one statistic each."""
    rng = np.random.default_rng(2)

    def text(i, symbols=0.03, marks=0.05, upper=0.04, dup=1, rep=1):
        word = lambda j: f"v{i}z{j}"
        words = [word(j).upper() if rng.random() < upper else word(j) + "#" if rng.random() < symbols else word(j) + "," if rng.random() < marks else word(j) for j in range(300)]
        lines = [" ".join(words[j : j + 10]) for j in range(0, 300, 10)]
        if rng.random() < 0.5 or dup > 1:
            lines += [f"x{i} y{i}"] * (1 + dup)
        if rng.random() < 0.5 or rep > 1:
            lines += [" ".join(f"q{i}w{j}" for j in range(5 + rep))] * 2
        return "\n".join(lines)

    far = [{"symbols": 0.9}, {"marks": 1.0}, {"upper": 1.0}, {"dup": 60}, {"rep": 30}]
    rows = [(i, text(i), "en", "s", 0) for i in range(400)] + [(1000 + i, text(1000 + i, **f), "en", "s", 0) for i, f in enumerate(far)]
    failed = {r.doc_id: r.failed.split(",") for r in qr.judge(spark.createDataFrame(rows, DOCS), fence=1.0).collect()}
    assert all(stat in failed[1000 + i] for i, stat in enumerate(qr.STATS)), failed
    assert sum(f != [""] for i, f in failed.items() if i < 1000) <= 20


def test_verdicts_by_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    out = qr.judge(spark.read.parquet(f"{data}/documents.parquet"))
    want = con.sql(f"select {', '.join(out.columns)} from ({qr.JUDGE_SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_quantiles_within_their_error(spark):
    xs = np.random.default_rng(3).lognormal(-3, 1, 5000)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(5)
    got = qr.quantiles(qr.sketch(df, [], ["x"]), [], {"q10": 0.1, "q50": 0.5, "q99": 0.99}).first()
    for name, p in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
        true = np.sort(xs)[math.ceil(p * len(xs)) - 1]
        assert true <= got[name] <= true * qr.GAMMA * (1 + 1e-9)


def test_sums_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    stats = rng.normal(size=(300, qc.N_STATS))
    y = rng.integers(0, 2, 300).astype(float)
    df = spark.createDataFrame([(i % 3, float(y[i]), stats[i].tolist()) for i in range(300)], "fold int, y double, stats array<double>").repartition(5)
    sums = qc.normal_equations(df, np.zeros(qc.N_STATS), np.ones(qc.N_STATS))
    phi = qc.fourier(stats)
    assert np.allclose(sum(a for a, _ in sums.values()), phi.T @ phi) and np.allclose(sum(b for _, b in sums.values()), phi.T @ y)
    assert np.allclose(sums[1][0], phi[1::3].T @ phi[1::3])


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(5).normal(size=(40, qc.N_STATS))
    phi = qc.fourier(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * qc.WIDTH**2))
    assert np.abs(phi @ phi.T - want).mean() < 1 / np.sqrt(qc.FEATURES)  # the error of one entry, drawn at random


def test_isotonic():
    x, v = qc.isotonic(np.arange(6.0), np.array([0, 1, 0, 0.5, 1, 1.0]), np.ones(6))
    assert (np.diff(v) >= 0).all() and (np.diff(x) > 0).all() and 0 < v[0] < v[-1] < 1


def test_fitted_scores_by_brute_force(spark, data):
    """Scores of the whole table against plain ridge over all features, and pools told by means of all their spans."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None}
    ids = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 5)
    x, y = np.array([qc.statistics(docs[i]) for i in ids]), np.array([labels[i] for i in ids], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    phi, fold = qc.fourier((x - mean) / scale), np.array([zlib.crc32(f"fold {i}".encode()) % qc.FOLDS for i in ids])
    ridge = np.diag([qc.RIDGE] * qc.FEATURES + [1e-9])
    solve = lambda p, t: np.linalg.lstsq(np.vstack([p, np.sqrt(ridge)]), np.concatenate([t, np.zeros(len(ridge))]), rcond=None)[0]
    raw = np.zeros(len(y))
    for f in set(fold):
        raw[fold == f] = phi[fold == f] @ solve(phi[fold != f], y[fold != f])
    bins = {}
    for r, t in zip(raw, y, strict=True):
        bins.setdefault(math.floor(min(max(r, -1), 2) * qc.BINS / 3), []).append((r, t))
    points = [(np.mean([r for r, _ in b]), sum(t for _, t in b), len(b)) for _, b in sorted(bins.items())]
    span = lambda j, k: sum(p[1] for p in points[j : k + 1]) / sum(p[2] for p in points[j : k + 1])
    level = [max(min(span(j, k) for k in range(i, len(points))) for j in range(i + 1)) for i in range(len(points))]
    pools = [[p for p, v in zip(points, level, strict=True) if v == u] for u in sorted(set(level))]
    knots = [sum(p[0] * p[2] for p in q) / sum(p[2] for p in q) for q in pools]
    values = np.maximum.accumulate([(sum(p[1] for p in q) + 0.5) / (sum(p[2] for p in q) + 1) for q in pools])
    weights = solve(phi, y)
    want = {i: np.interp(qc.fourier((np.array([qc.statistics(t)]) - mean) / scale) @ weights, knots, values)[0] for i, t in docs.items()}
    got = {r.doc_id: r.quality_score for r in qc.classify(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-5 and len({round(v, 3) for v in got.values()}) > 10


def test_held_out_accuracy(spark):
    from strata.llm.queries import op10_quality

    data = "/root/testdata/sf0.01"
    rows = [r for r in op10_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect() if r.held_out]
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)


@pytest.mark.parametrize("labels", [[], [(0, None), (None, 1)], [(i, i % 2) for i in range(40)] * 2])
def test_edge_rows(spark, docs, clashing, labels):
    rows = [*enumerate(ODD), (20, "a b"), (20, "a b"), (None, "a b")]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    for make in (docs, clashing):
        source = make(rows)
        out = qc.classify(source, known)
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 and r.quality_predicted == (r.quality_score >= 0.3) for r in got)
        assert {*source.columns} - {"quality_score"} <= {*out.columns}
    assert qc.classify(docs([]), known).count() == 0
