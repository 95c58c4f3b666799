"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Whether a text holds an n-gram (3 to 6 letters and word ends, hashed) is a feature. Each bucket's
counts in toxic and other texts give its log-count ratio; the buckets whose ratio is surest are kept. A logistic
regression over presence times ratio is trained on them, in which both classes weigh alike however many rows each has. All training is on a bounded sample of labelled rows, about
`per_class` of each class, drawn by a hash of the doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, fresh, table
from .grams import code_points, gram_buckets
from .langid import fold, sampled

#: Sizes of grams; bits of a bucket; buckets kept; rows of a class to train on; the regression's penalty and steps.
SIZES, BITS, KEPT, PER_CLASS, PENALTY, STEPS = (3, 4, 5, 6), 20, 3000, 5000, 1e-4, 400
THRESHOLD = 0.7


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """The buckets of a text's grams, with repeats."""
    points = code_points(text or "")
    return np.concatenate([gram_buckets(points, size, bits) for size in SIZES])


@dataclass
class ToxicityModel:
    """place[bucket] is a feature's place or -1; weights are for presence, ratio included."""

    place: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def present(self, text: str | None) -> np.ndarray:
        at = self.place[buckets(text, self.bits)]
        return np.unique(at[at >= 0])

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratios(labelled: DataFrame, bits: int = BITS, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The buckets kept and their log-count ratios, from all of `labelled` (text, toxic).

    The driver gets the buckets that the sample's texts hold: 2^bits rows of 24 bytes at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int32)
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[toxic][np.unique(buckets(text, bits))] += 1
                n[toxic] += 1
        seen = np.flatnonzero(total.any(axis=0))
        columns = [np.append(seen, -1), np.append(total[0][seen], n[0]), np.append(total[1][seen], n[1])]
        if any(n):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bucket", "other", "toxic"])

    counts = labelled.select("text", "toxic").mapInArrow(count, "bucket long, other long, toxic long")
    got = counts.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, other, toxic = (got[c].to_numpy() for c in ("bucket", "other", "toxic"))
    totals = bucket == -1
    n_other, n_toxic = int(other[totals].sum()), int(toxic[totals].sum())
    bucket, other, toxic = bucket[~totals], other[~totals], toxic[~totals]
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))
    sure = np.abs(ratio) / np.sqrt(1 / (toxic + 1) + 1 / (other + 1))
    best = np.lexsort((bucket, -sure))[:kept]
    return bucket[best], ratio[best]


def train_logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over presence times `scale`, by accelerated descent; classes weigh alike."""
    own = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    at, of = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = scale[at]
    forward = lambda w, bias: np.bincount(of, w[at] * x, len(rows)) + bias
    backward = lambda e: (np.bincount(at, e[of] * x, len(scale)), e.sum())
    # The step follows from the largest eigenvalue of the loss's bound, found by powers.
    v, v_bias, largest = np.ones(len(scale)), 1.0, 1.0
    for _ in range(15):
        size = float(np.sqrt(v @ v + v_bias**2)) or 1.0
        v, v_bias = backward(forward(v / size, v_bias / size) * own)
        largest = float(np.sqrt(v @ v + v_bias**2))
    step = 1 / (largest / 4 * 1.1 + penalty)
    w, bias, ahead, ahead_bias, t = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(forward(ahead, ahead_bias), -30, 30))) - y) * own
        down, down_bias = backward(error)
        new, new_bias = ahead - step * (down + penalty * ahead), ahead_bias - step * down_bias
        next_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / next_t * (new - w), new_bias + (t - 1) / next_t * (new_bias - bias)
        w, bias, t = new, new_bias, next_t
    return w * scale, float(bias)


def train(labelled: DataFrame, bits: int = BITS, kept: int = KEPT, per_class: int = PER_CLASS) -> ToxicityModel:
    """A model from `labelled` (doc_id, text, toxic 0 or 1). Without toxic rows, or without others, it scores their share."""
    labelled = labelled.where("toxic IN (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    labelled = cut(sampled(labelled, "toxic", per_class, 2 * per_class))
    chosen, ratio = log_count_ratios(labelled, bits, kept)
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    bare = ToxicityModel(place, np.zeros(len(chosen)), 0.0, bits)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [bare.present(x).astype("<i4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.binary())], names=["toxic", "row"])

    got = labelled.mapInArrow(present, "toxic int, row binary").toArrow()
    found = sorted(zip(got["toxic"].to_pylist(), got["row"].to_pylist()))
    y = np.array([t for t, _ in found], float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return ToxicityModel(place, np.zeros(len(chosen)), float(np.log(share / (1 - share))), bits)
    weights, bias = train_logistic([np.frombuffer(r, "<i4") for _, r in found], y, ratio)
    return ToxicityModel(place, weights.astype(np.float32), bias, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, toxic) of a sample of `labels` (doc_id, toxic); a doc_id with several labels counts as toxic if one is.

    The sample is drawn before the join, so what is broadcast is bounded: about 2 * per_class rows of 12 bytes.
    """
    worst = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(cut(sampled(worst, "toxic", per_class, 2 * per_class))), "doc_id")


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 where score is `threshold` or more).

    Whole texts are read; a null or empty text has no grams and gets the score of the bias alone. Other columns pass
    through; clashing names get a leading underscore.
    """
    score_name, predicted_name = fresh(docs, "score", "predicted")
    schema, at = extended(docs, (score_name, "double"), (predicted_name, "integer")), docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x) for x in batch.column(at).to_pylist()]
            predicted = pa.array([int(x >= threshold) for x in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), predicted], names=schema.names)

    return docs.mapInArrow(score, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `documents`, learned from labels that aren't held out.

    labelled_sample() and score_texts() state the odd cases; a null doc_id has no label. An empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(docs, 3) == 1
    labels = table(spark, sf_dir, "labels")
    model = train(labelled_sample(docs, labels.where(fold(labels, 3) != 1)))
    return score_texts(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
