"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is text from the corpus, labels unseen. The class
prior is the share of 1 among the labels that may be seen, if these hold both classes (nothing else is learnt from
labels of 0); else a first classifier of positives against unlabelled gives it: the least ratio, over score
thresholds, of the unlabelled share above to the positive share above. The final linear model minimises the non-negative unbiased
risk: prior * loss of positives as positive + max(0, loss of unlabelled as negative - prior * loss of positives as
negative). A score is the model's probability of label 1.

Features see the text only: square roots of byte and byte-pair frequencies, repetition of words and lines, shares
of letter cases, digits and symbols. Fitting uses at most about `positives` + `unlabelled` rows, chosen by a hash of
doc_id, one for each; every row is scored, whole texts.

Defined results: a null text is scored as an empty one; a null doc_id is scored and never fitted on; rows that
repeat get the same score; a document with labels that differ counts as its lowest; without any positive (or any
document) to fit on, every score is 0.5. Columns named score and predicted are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import small_batches, text_bytes

PAIRS, STATS = 256, 14
SIZE = 256 + PAIRS + STATS


def features(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    out = np.zeros(SIZE, np.float32)
    if not len(b):
        return out
    one = np.bincount(b, minlength=256) / len(b)
    out[:256] = np.sqrt(one)
    if len(b) > 1:
        pair = (b[:-1].astype(np.uint32) * 2654435761 + b[1:] * np.uint32(40503)) >> np.uint32(24)
        out[256 : 256 + PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / (len(b) - 1))
    words = text.split()
    n = max(len(words), 1)
    lines = text.split(b"\n")
    different = len(set(words)) / n
    again = sum(map(eq, words, words[1:])) / n
    upper, lower, digit = one[65:91].sum(), one[97:123].sum(), one[48:58].sum()
    marks = one[33:48].sum() + one[58:65].sum() + one[91:97].sum() + one[123:127].sum()
    size = np.log1p(len(b))
    out[-STATS:] = [
        1, size / 10, different, different * size / 10, again, len(set(lines)) / len(lines), upper / (upper + lower + 1e-9),
        digit, marks, one[128:].sum(), len(b) / n / 10, np.log1p(n) / 10, min(len(b) / n, 40) / 40, np.log1p(len(lines)) / 10,
    ]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = np.stack([features(t) for t in texts]).astype(float) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimated_prior(p: np.ndarray, u: np.ndarray, decay: float = 1e-3) -> float:
    """Share of positives in u: how little of u lies above a threshold, for what lies above it of p.

    Each half is ranked by a classifier fitted on the other, so what it learnt by heart does not count.
    """
    above_p, above_u = np.zeros(51), np.zeros(51)
    for k in (0, 1):
        a, b, x, y = p[k::2], u[k::2], p[1 - k :: 2], u[1 - k :: 2]
        if not min(len(a), len(b), len(x), len(y)):
            return 0.5

        def gradient(w: np.ndarray, a: np.ndarray = a, b: np.ndarray = b) -> np.ndarray:
            return -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + decay * w

        w = _adam(gradient, p.shape[1], 150)
        s, t = np.sort(x @ w), np.sort(y @ w)
        at = np.quantile(s, np.linspace(0, 0.5, 51))
        above_p += (1 - np.searchsorted(s, at) / len(s)) / 2
        above_u += (1 - np.searchsorted(t, at) / len(t)) / 2
    slack = 0.5 / np.sqrt(len(u)) + 0.5 / np.sqrt(len(p))  # a ratio of few rows may be low by chance
    return float(np.clip(np.min((above_u + slack) / above_p), 0.02, 0.98))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """Non-negative unbiased risk of weights w with logistic loss, and the direction in which training descends.

    While the part of the negatives is not negative that is the gradient; below it, the step goes back along that part.
    """
    zp, zu = p @ w, u @ w
    sp, su = _sigmoid(zp), _sigmoid(zu)
    as_positive = prior * np.logaddexp(0, -zp).mean()
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    value = as_positive + max(0.0, as_negative) + decay * (w @ w) / 2
    if as_negative < 0:  # the unbiased estimate has gone below what a risk can be: step back
        return value, -g_negative + decay * w
    return value, -prior * (p.T @ (1 - sp)) / len(p) + g_negative + decay * w


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, decay: float = 3e-2, steps: int = 400) -> Model:
    """Minimises the non-negative unbiased risk of a linear model with logistic loss."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(SIZE), 0.0, 0.5)
    mean, std = unlabelled.mean(0), unlabelled.std(0)
    scale = 1 / np.maximum(std, 0.02)
    wide = lambda x: np.hstack([(x - mean) * scale, np.ones((len(x), 1))])
    p, u = wide(positive.astype(float)), wide(unlabelled.astype(float))
    prior = estimated_prior(p, u) if prior is None else prior
    w = _adam(lambda w: risk(w, p, u, prior, decay)[1], p.shape[1], steps)
    weights = w[:-1] * scale
    return Model(weights, float(w[-1] - mean @ weights), prior)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 10_000) -> Model:
    """Fits on rows whose fold is not 1: labels (doc_id, quality) there name the positives."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "x"])

    def gathered(df: DataFrame) -> np.ndarray:
        got = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(rows, "doc_id long, x binary").toPandas().sort_values("doc_id")
        return np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, SIZE)

    open_rows = F.coalesce(fold() != 1, F.lit(False))
    seen = labels.filter(open_rows & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ones, every = seen.agg(F.sum("quality"), F.count(F.lit(1))).first()
    best = seen.filter("quality = 1").select("doc_id")
    chosen = best.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(positives)  # bounded, so it may be broadcast
    # an id counts once, however many rows have it, so both samples stay bounded
    p = gathered(docs.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    share = min(1.0, unlabelled / max(docs.count(), 1))
    last = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))  # of the 64-bit hashes, this share lies below
    u = gathered(docs.filter(open_rows & (F.xxhash64("doc_id", F.lit(9)) <= last)).groupBy("doc_id").agg(F.min("text").alias("text")))
    return fit(p, u, ones / every if ones and ones < every else None)


def scored(docs: DataFrame, model: Model, least: float = 0.5, only_good: bool = False) -> DataFrame:
    """docs with score and predicted (1 if score >= least); only_good: the rows predicted 1, without the two columns."""
    small_batches(docs.sparkSession)
    frame = docs if only_good else docs.drop("score", "predicted")
    names = frame.columns
    schema = frame.schema if only_good else T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score([b"" if t is None else t.encode() for t in b.column("text").to_pylist()])
            if only_good:
                yield b.filter(pa.array(s >= least))
            else:
                cols = [b.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= least).astype(np.int32))], names=[*names, "score", "predicted"])

    return frame.mapInArrow(rows, schema)
