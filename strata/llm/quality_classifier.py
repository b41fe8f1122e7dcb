"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Random Fourier features turn a Gaussian kernel over the statistics into a plain inner product, so the kernel ridge fit
needs only sums: each task adds up its rows' part of the normal equations, Spark adds those, and a small system remains.
Such sums can also be subtracted, which gives fits without a fold, and so out-of-fold scores to calibrate on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import joined, map_rows, materialise, small_batches, to_arrow

FEATURES, SEED, RIDGE, FOLDS, BINS = 160, 20240601, 0.5, 4, 2_000
#: Kernel width in standard deviations of the statistics.
WIDTH = 5.0
THRESHOLD = 0.3
ASCII = np.arange(256)
KINDS = [np.isin(ASCII, [ord(c) for c in s]) for s in ("#*$%&", "|<>", "!?", ".,;:", "0123456789", "@/\\_=+-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiouAEIOU")] + [ASCII >= 128]
N_STATS = len(KINDS) + 9


def statistics(text: str) -> list[float]:
    """N_STATS numbers of one whole text, whatever its language; none depends on anything but the text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [np.sqrt(by_byte[k].sum() / size) for k in KINDS] + [
        np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), distinct / max(1, n) ** 0.9, same / max(1, n),
        triples / max(1, n - 2), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(w[-1:].isalnum() for w in words) / max(1, n),
    ]


@dataclass(frozen=True)
class Quality:
    """A fitted model: small arrays only, so it travels with the tasks."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values) if len(self.knots) else np.full(len(stats), 0.5)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant; the draw is the same on every executor."""
    rng = np.random.default_rng(SEED)
    at = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ at + phase), np.ones((len(x), 1))])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, y and stats of the labelled documents that may be learned from."""
    usable = F.coalesce(~held_out(F.col("doc_id")), F.lit(False))
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(usable & F.col("y").isNotNull())
    texts = joined(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(usable), known, "doc_id", "inner")

    def make():
        def handle(batch):
            for fold, y, text in zip(batch["fold"], batch["y"], batch["text"], strict=True):
                yield fold, y, statistics(text)
        return handle

    return map_rows(texts.select(F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string"))), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text"), make, "fold int, y double, stats array<double>")


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By fold: the sums of phi phi' and phi y. Each task adds up its rows and sends one triangle of fixed size a fold."""
    d = FEATURES + 1
    up = np.triu_indices(d)
    small_batches(rows.sparkSession)
    schema = to_arrow(rows.sparkSession, "fold int, at int, v double")

    def run(batches):
        added: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, y = batch["fold"].to_numpy(), batch["y"].to_numpy()
            phi = fourier((np.array(batch["stats"].to_pylist()).reshape(-1, len(mean)) - mean) / scale)
            for f in set(folds.tolist()):
                p = phi[folds == f]
                added[f] = added.get(f, 0) + np.concatenate([p.T @ y[folds == f], (p.T @ p)[up]])
        for f, v in added.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f), pa.int32()), pa.array(np.arange(-d, len(v) - d), pa.int32()), pa.array(v)], schema=schema)

    sums = rows.mapInArrow(run, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for f, part in sums.groupby("fold"):
        v = part.set_index("at")["v"]
        a = np.zeros((d, d))
        a[up] = v.loc[range(len(up[0]))].to_numpy()
        out[int(f)] = (a + np.triu(a, 1).T, v.loc[range(-d, 0)].to_numpy())
    return out


def ridge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    penalty = RIDGE * np.eye(len(a))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points x in order with means y of n rows: knots and values to interpolate between.

    The ends get half a row of each label, so that no score is quite 0 or 1.
    """
    pools: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        pools.append([xi * ni, yi * ni, ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], np.maximum.accumulate((p[:, 1] + 0.5) / (p[:, 2] + 1))


def fit(docs: DataFrame, labels: DataFrame) -> Quality:
    """Fits on the labelled documents outside the held-out fifth. With no such row, every score is 0.5."""
    rows = materialise(labelled(docs, labels))
    wide = [F.col("stats")[i] for i in range(N_STATS)]
    sums = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(wide)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(wide))).first()
    if not sums["n"]:
        return Quality(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, scale = (np.array([sums[f"{k}{i}"] for i in range(N_STATS)]) for k in "ms")
    scale = np.where(scale < 1e-9, 1.0, scale)
    folds = normal_equations(rows, mean, scale)
    a, b = (sum(f[i] for f in folds.values()) for i in (0, 1))
    without = {f: ridge(a - fa, b - fb) for f, (fa, fb) in folds.items()} if len(folds) > 1 else {f: ridge(a, b) for f in folds}

    def make():
        def handle(batch):
            folds_of, y = np.array(batch["fold"]), np.array(batch["y"])
            phi = fourier((np.array(batch["stats"]) - mean) / scale)
            raw = np.zeros(len(y))
            for f, w in without.items():
                raw[folds_of == f] = phi[folds_of == f] @ w
            bins = np.floor(np.clip(raw, -1, 2) * BINS / 3).astype(int)
            yield from zip(bins.tolist(), raw.tolist(), y.tolist(), strict=True)
        return handle

    points = map_rows(rows, make, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    return Quality(mean, scale, ridge(a, b), *isotonic(points["x"].to_numpy(), points["y"].to_numpy(), points["n"].to_numpy(float)))


def score_column(model: Quality):
    """A function text -> score (0 to 1) for use in select."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype="float64")
        return pd.Series(np.clip(model.score(np.array([statistics(t or "") for t in text])), 0.0, 1.0))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Quality | None = None) -> DataFrame:
    """docs with quality_score and quality_predicted (1 if the score reaches the threshold, else 0).

    docs: doc_id, text; labels: doc_id, quality. Other columns of docs are kept, save two of these names, which are
    replaced. Whole texts are scored, however long; a null or empty text as empty. Null labels aren't learned from; each
    label of an id, repeated or conflicting, is learned from with each of the id's rows; repeated rows score alike, and rows
    of null id are scored too. Without usable labels every score is 0.5; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    scored = docs.withColumn("quality_score", score_column(model)(F.coalesce("text", F.lit(""))))
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))
