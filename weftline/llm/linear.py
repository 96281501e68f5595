"""A hashed linear text model: word 1- and 2-grams and character 3-grams, logistic regression, Platt calibration.

A model may also see a repetition profile: how many words back each word 2-gram
occurred before, in powers of two.

A text's vector holds, for each kind, the share of each bucket
among the text's n-grams of that kind, so its score is a mean of weights and is
computed for a batch of texts with one gather and prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .tokens import Words, mix, windows

BITS = 15
BUCKETS = 1 << BITS
_MASK = np.uint64(BUCKETS - 1)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _gaps(pairs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each 2-gram, 0 if it is new in its text, else 1 and the binary logarithm of its distance to the last one."""
    own = pairs ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    out = np.zeros(len(own), np.int32)
    again = np.flatnonzero(own[order][1:] == own[order][:-1]) + 1
    out[order[again]] = 1 + np.log2(order[again] - order[again - 1]).astype(np.int32)
    return out


def buckets(words: Words, repeats: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its bucket (kinds have separate ranges), and each text's offset into these."""
    chars = words.chars()
    h = words.hashes(chars)
    pairs, at = windows(h, words.doc, 2)
    bounds = np.concatenate([np.zeros(1, np.int64), words.text_end + 1])
    n = max(0, len(chars) - 2)
    grams = (chars[:n] * _A + chars[1 : n + 1]) * _B + chars[2:]
    inside = np.ones(n + 2, bool)
    inside[words.text_end] = False  # an n-gram lies in one text
    inside = inside[:n] & inside[1 : n + 1] & inside[2 : n + 2]
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    grams = (grams[inside] >> np.uint64(64 - BITS)).astype(np.int32)
    first = np.searchsorted(at, words.first)
    profile = [(_gaps(pairs, words.doc[at]) + 3 * BUCKETS, first)] if repeats else []
    return profile + [
        ((h & _MASK).astype(np.int32), words.first),
        ((pairs & _MASK).astype(np.int32) + BUCKETS, first),
        (grams + 2 * BUCKETS, upto[np.minimum(bounds, n)]),
    ]


def means(groups: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """For each text, the sum over kinds of the mean weight."""
    total = 0.0
    for index, first in groups:
        sums = np.concatenate([np.zeros(1), np.cumsum(weights[index])])[first]
        total = total + np.diff(sums) / np.maximum(np.diff(first), 1)
    return total


def vectors(texts: list[str], repeats: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and shares."""
    groups = buckets(Words(texts), repeats)
    for i in range(len(texts)):
        parts = [np.unique(index[first[i] : first[i + 1]], return_counts=True) for index, first in groups]
        yield np.concatenate([a for a, _ in parts]).astype(np.int32), np.concatenate([n / max(1, n.sum()) for _, n in parts]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """weights over buckets, and the calibration: probability = sigmoid(slope * score + offset)."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.slope * means(groups, self.weights) + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _featurise(repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 0):
            found = list(vectors(texts, repeats))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32()))],
                names=["target", "calibrates", "key", "buckets", "shares"],
            )

    return run


def one_text_each(rows: DataFrame) -> DataFrame:
    """One row (doc_id, text, target) of each doc_id, so that a bound on ids bounds the rows too."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text", "target")).alias("r")).select("doc_id", "r.text", "r.target")


def fit(rows: DataFrame, prior: float | None = None, repeats: bool = False, steps: int = 60, rate: float = 1.0, l2: float = 1e-6) -> Model | None:
    """A calibrated model from rows (text, target in 0..1, fold); the caller bounds the number of rows.

    Rows with fold 0 calibrate, the others train. Vectors are made on the
    executors, and only they reach the driver, which orders them by a hash of
    the text. None if either class is missing. prior: share of the upper class
    where the model will be used, if it differs from its share among the rows;
    the calibration is shifted to it.
    """
    sample = rows.select("text", F.col("target").cast("double").alias("target"), (F.col("fold") == 0).alias("calibrates"), F.xxhash64("text").alias("key"))
    got = sample.mapInArrow(_featurise(repeats), "target double, calibrates boolean, key long, buckets array<int>, shares array<float>").toArrow()
    got = got.take(pa.array(np.lexsort((got.column("key").to_numpy(), got.column("target").to_numpy()))))
    parts = []
    for part in (got.filter(pc.invert(got.column("calibrates"))), got.filter(got.column("calibrates"))):
        index, shares = part.column("buckets").combine_chunks(), part.column("shares").combine_chunks()
        parts.append((part.column("target").to_numpy(), pc.list_value_length(index).to_numpy(zero_copy_only=False), index.flatten().to_numpy(), shares.flatten().to_numpy().astype(np.float64)))
    (y, n, index, share), (cy, cn, cindex, cshare) = parts
    if not len(y) or y.min() > 0.5 or y.max() < 0.5:
        return None
    row = np.repeat(np.arange(len(y)), n)
    balance = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
    w, b, g2 = np.zeros(4 * BUCKETS), 0.0, np.full(4 * BUCKETS, 1e-8)
    for _ in range(steps):
        error = balance * (sigmoid(np.bincount(row, w[index] * share, len(y)) + b) - y) / len(y)
        g = np.bincount(index, error[row] * share, 4 * BUCKETS) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        b -= error.sum()
    crow = np.repeat(np.arange(len(cy)), cn)
    score, target = (np.bincount(crow, w[cindex] * cshare, len(cy)), cy) if len(cy) else (np.bincount(row, w[index] * share, len(y)), y)
    slope, offset = platt(score, target)
    if prior is not None:
        odds = lambda p: np.log(p) - np.log(1 - p)
        share = np.clip([prior, target.mean()], 0.01, 0.99)
        offset += float(odds(share[0]) - odds(share[1]))
    return Model(w, slope, offset)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out scores, with Platt's smoothed targets, by Newton steps."""
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    y = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-9, float(np.abs(score - score.mean()).mean()))
    x, a, c = (score - score.mean()) / scale, 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + c)
        r, v = p - y, p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        da, dc = np.linalg.solve(h, np.array([(r * x).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * c]))
        step = min(1.0, 2.0 / max(1e-9, abs(da), abs(dc)))
        a, c = a - step * da, c - step * dc
    return float(a / scale), float(c - a * score.mean() / scale)
