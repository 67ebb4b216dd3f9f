"""Graded quality by ordinal cumulative-link regression on hashed text.

P(grade <= j) = logistic(threshold_j - w . x) with one weight vector for all grades and ascending thresholds.  x holds the
shares of a document's hashed words and of their shapes (capitals to A, small letters to a, digits to 0, each once in a row),
and buckets of a few figures of the whole text: length, share of distinct words, of words that repeat the one before, of capitals, of signs.  Expected grade and
tail probability P(grade >= cut) come from the same cumulative probabilities.  The model is fitted on the driver to at most
``per_grade`` rated documents of each grade; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnum import LOWER, Texts, U, batches, mix, prefix, spans, words
from .common import bounded_batches, held_out
from .toxicity import labelled, sigmoid

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades


def features(data: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each entry of x."""
    n = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    count = np.bincount(row, minlength=n)
    share = 1 / np.sqrt(np.maximum(count, 1))[row] / 2
    low, shape = LOWER[data], SHAPE[data]
    word = spans(prefix(low), starts, ends)
    # shapes: drop what repeats the byte before within a word
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    kinds = spans(prefix(shape[new]), place[starts], place[ends]) if len(starts) else np.zeros(0, U)
    distinct = np.zeros(n)
    if len(word):
        order = np.lexsort((word, row))
        first = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])])
        distinct = np.bincount(row[order][first], minlength=n)
    size = np.maximum(np.diff(offsets), 1)
    whole = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    capitals = whole((data >= 65) & (data < 91))
    signs = whole(((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128)))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    repeated = np.bincount(row, again, n) / np.maximum(count, 1)
    figures = [16 * repeated, np.log2(count + 1), 16 * distinct / np.maximum(count, 1), np.minimum(40 * capitals, 20), np.minimum(40 * signs, 20)]
    marks = [mix(np.floor(x).astype(U) + U(1000 * (k + 1))) for k, x in enumerate(figures)]
    rows = np.concatenate([row, row, *[np.arange(n)] * len(marks)])
    bucket = (np.concatenate([word, kinds ^ U(3), *marks]) & U(dims - 1)).astype(np.int64)
    return rows, bucket, np.concatenate([share, share, np.full(n * len(marks), 0.5)])


def fitted(y: np.ndarray, weight: np.ndarray, rows: np.ndarray, bucket: np.ndarray, value: np.ndarray, grades: int, dims: int, steps: int = 120, rate: float = 0.05, decay: float = 3e-5) -> Model:
    """Adam on the weighted log likelihood; thresholds are a first one and logarithms of the gaps."""
    names, bucket = np.unique(bucket, return_inverse=True)
    c = weight / weight.sum()
    w, first, gaps = np.zeros(len(names)), -2.0, np.zeros(grades - 2)
    m, v = np.zeros(len(names) + grades - 1), np.zeros(len(names) + grades - 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[bucket] * value, len(y))
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        upper, lower = np.append(theta, np.inf)[y], np.concatenate([[-np.inf], theta])[y]
        a, b = np.where(np.isinf(upper), 1.0, sigmoid(upper - z)), np.where(np.isinf(lower), 0.0, sigmoid(lower - z))
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gz = c * (da - db)
        g_theta = np.array([-(c * da)[y == k].sum() + (c * db)[y == k + 1].sum() for k in range(grades - 1)])
        g_gaps = np.array([g_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(grades - 2)])
        grad = np.concatenate([np.bincount(bucket, gz[rows] * value, len(names)) + decay * w, [g_theta.sum()], g_gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, first, gaps = w - step[: len(names)], first - step[len(names)], gaps - step[len(names) + 1 :]
    weights = np.zeros(dims, np.float32)
    weights[names] = w
    return Model(weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


EXAMPLES = pa.schema([("grade", pa.int64()), ("doc_id", pa.int64()), ("bucket", pa.binary()), ("value", pa.binary())])


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int = 3, per_grade: int = 2500, dims: int = 1 << 18, longest: int = 1 << 20) -> Model:
    """Model from ratings (doc_id and ``grade``, 0 to grades - 1) of documents that aren't held out, chosen by ``labelled``: at most
    ``per_grade`` of each grade, of at most ``longest`` characters.  Without any rating all documents get the same figures."""
    totals, sample = labelled(docs, ratings, grade, list(range(grades)), per_grade, longest)

    def numbers(batch):
        texts = Texts(batch.column("text"))
        for i, j, data, offsets in texts.chunks():
            rows, bucket, value = features(data, offsets, dims)
            key, inverse = np.unique(rows * dims + bucket, return_inverse=True)
            value = np.bincount(inverse, value).astype(np.float32)
            bounds = np.searchsorted(key // dims, np.arange(j - i + 1))
            key = (key % dims).astype(np.int32)
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]  # noqa: B023, E731
            yield [batch.column("label").slice(i, j - i).cast(pa.int64()), batch.column("doc_id").slice(i, j - i), cut(key), cut(value)]

    found = sample.mapInArrow(lambda it: batches(it, EXAMPLES, numbers), "grade long, doc_id long, bucket binary, value binary").collect()
    if not found:
        return Model(np.zeros(dims, np.float32), np.arange(grades - 1) - 2.0)
    found.sort(key=lambda r: (r.doc_id, r.grade, bytes(r.bucket)))
    y = np.array([r.grade for r in found])
    taken = np.bincount(y, minlength=grades)
    # graded as rare as they are, but with a weight of at least a tenth for each grade
    weight = np.array([max(totals[g] / taken[g], 0.1 * len(y) / taken[g]) for g in y])
    sizes = [len(r.bucket) // 4 for r in found]
    return fitted(y, weight, np.repeat(np.arange(len(y)), sizes), np.frombuffer(b"".join(r.bucket for r in found), np.int32).astype(np.int64), np.frombuffer(b"".join(r.value for r in found), np.float32).astype(float), grades, dims)


SCORED = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64())])


def grade(docs: DataFrame, model: Model, cut: int = 1, least: float = 0.5) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, held_out, expected_grade, tail_prob =
    P(grade >= cut) and kept (tail_prob >= least).  A null text counts as empty and is graded by its figures alone.
    Repeated rows get the same result; a long text is graded whole."""

    def one(batch):
        texts = Texts(batch.column("text"))
        for i, j, data, offsets in texts.chunks():
            rows, bucket, value = features(data, offsets, len(model.weights))
            z = np.bincount(rows, model.weights[bucket] * value, j - i)
            over = 1 - sigmoid(model.thresholds[None, :] - z[:, None])
            yield [batch.column("doc_id").slice(i, j - i), over.sum(1), over[:, cut - 1]]

    return (
        bounded_batches(docs)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda it: batches(it, SCORED, one), "doc_id long, expected_grade double, tail_prob double")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= least).alias("kept"))
    )
