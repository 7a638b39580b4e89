"""Document quality by Bradley-Terry ranking of preference pairs.

Each document has a latent score w . f(text); the chance that it is preferred to another is the logistic function of
the difference of scores. w minimises the logistic loss over feature differences of preference pairs, with a ridge.
A pair takes a document of label 1 before one of label 0. Documents are then kept by a quantile of the score, or the
score is turned to a probability by a logistic curve fitted to the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_text, ship, staged
from textloom.llm.toxicity import _logistic, bucket

FEATURES = ("log_words", "upper", "symbols", "bars", "bangs", "digits", "word_length", "distinct_words", "repeated_lines", "lines", "stops", "commas", "short_words", "other_bytes", "capitals", "longest_word", "common_word")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"]] = True


def features(text: str | None) -> list[float]:
    """Shape of a text: what it is written with, how its words and lines repeat. All zero without words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = max(1, len(raw) - int(seen[[32, 9, 10, 11, 12, 13]].sum()))
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = set(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    first = b"".join([w[:1] for w in words])
    return [
        np.log1p(n), upper / max(1, upper + lower), float(seen[_PUNCTUATION].sum()) / solid, seen[124] / n, seen[33] / n, float(seen[48:58].sum()) / solid, min(20.0, solid / n),
        len(kinds) / n ** 0.85, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n, seen[46] / n, seen[44] / n, float((lengths <= 3).mean()), float(seen[128:].sum()) / solid,
        sum(65 <= c <= 90 for c in first) / n, np.log1p(int(lengths.max())), np.log1p(n - len(kinds)) / np.log1p(n),
    ]


@dataclass
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([z, z * z / 4, np.maximum(0, z - 1)])

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.latent(x) + self.offset, -30, 30)))


def fit_pairs(x: np.ndarray, winners: np.ndarray, losers: np.ndarray, ridge: float = 1.0, steps: int = 25) -> BradleyTerry:
    """Weights from pairs of rows of x, each a winner and a loser, by Newton's method."""
    model = BradleyTerry(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(0))
    f = model.expand(x)
    d = f[winners] - f[losers]
    w = np.zeros(d.shape[1])
    share = len(d) / max(1, len(x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = ridge * share * w - d.T @ p
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * share * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def fit(x: np.ndarray, y: np.ndarray, *, pairs_each: int = 12, seed: int = 7) -> BradleyTerry:
    """A model from labelled rows: each row of the rarer label meets pairs_each of the other, drawn evenly."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        width = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
        share = (len(good) + 1) / (len(y) + 2)
        return BradleyTerry(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    a = np.repeat(few, pairs_each)
    order = np.concatenate([rng.permutation(many) for _ in range(-(-len(a) // len(many)))])[: len(a)]
    winners, losers = (order, a) if few is bad else (a, order)
    model = fit_pairs(x, winners, losers)
    model.slope, model.offset = _logistic(model.latent(x)[:, None], y)
    return model


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features (array of double) for each row of docs; a null text counts as empty."""
    return per_text(docs, "features array<double>", lambda: lambda texts: [[features(t) for t in texts]], id_col, text_col)


def scored(rows: DataFrame, model: BradleyTerry) -> DataFrame:
    """rows (doc_id, features) with latent and score in place of features."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.latent(x)), pa.array(shared.value.probability(x))], ["doc_id", "latent", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, latent double, score double")


def classify(docs: DataFrame, labels: DataFrame, *, per_class: tuple[int, int] = (8000, 12000), threshold: float = 0.3, quantile: float = 0.15) -> DataFrame:
    """doc_id, held_out, score, predicted and kept for each row of docs.

    Learns labels.quality from rows whose crc32(doc_id) mod 5 is not 0, at most per_class = (label 0, label 1)
    documents, those with the least hash of their id; an id that repeats gives one. score is the chance of label 1;
    kept is false for documents under the given quantile of the latent score of all rows, ties staying. Null and empty
    texts have features of 0 and a score like any other, very long texts are read whole, and rows that repeat each give
    their row; a null id has held_out null. Without labels of both kinds all rows score alike, the share of label 1, and
    are kept. An empty table gives an empty result. Other columns of docs are ignored.
    """
    rows = staged(featured(docs), "quality_features")
    usable = labels.filter((bucket(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy(F.col("doc_id").alias("_l")).agg(F.max("quality").cast("int").alias("_y"))
    picked = [usable.filter(F.col("_y") == y).orderBy(F.xxhash64("_l"), "_l").limit(n) for y, n in enumerate(per_class)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most sum(per_class) ids
    known = rows.join(sample, F.col("doc_id") == F.col("_l")).groupBy("_l").agg(F.min("features"), F.first("_y"))
    got = sorted((r[0], r[1], r[2]) for r in known.collect())
    model = fit(np.array([r[1] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r[2] for r in got], int))
    out = scored(rows, model)
    cut = out.agg(F.percentile_approx("latent", F.lit(quantile))).first()[0]
    kept = F.lit(True) if cut is None else F.col("latent") >= F.lit(cut)
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), kept.alias("kept"))
