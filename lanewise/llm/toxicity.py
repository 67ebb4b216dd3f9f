"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of the weights of its words and of their first 4, 5 and 6 bytes (stems that
take endings); a document's is their noisy-or, q = 1 - prod(1 - p_s).  Labels are noisy, so they are taken as P(label = 1) = leak + (1 - leak - miss) * q with leak and miss
learnt too; without them every clean sentence would carry a share of the wrong labels, and long clean documents would end up
toxic.  The weights are fitted to a sample of at most ``per_class`` labelled documents of each class: tasks count the sample's
documents by feature and label and keep features whose likelihood ratio speaks for the label (G^2 of at least ``evidence``);
the driver gets these features of each sentence as numbers.  Rows of the sample are weighted by how many labels they stand
for.  Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnum import LOWER, PLAIN, Texts, U, batches, prefix, spans, words
from .common import bounded_batches, held_out, settled

END = np.zeros(256, bool)
END[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, a power of two
    bias: float


STEMS = (4, 5, 6)
KINDS = 1 + len(STEMS)


def parts(data: np.ndarray, offsets: np.ndarray, dims: int):
    """Buckets of each word and its stems (0 for none), first word of each sentence that has one, its row, first and last byte."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, PLAIN)
    if not len(starts):
        return np.zeros((0, KINDS), np.int64), *(np.zeros(0, np.int64),) * 4
    sums = prefix(low)
    bucket = np.zeros((len(starts), KINDS), np.int64)
    bucket[:, 0] = spans(sums, starts, ends) & U(dims - 1)
    for k, n in enumerate(STEMS, 1):
        long = np.flatnonzero(ends - starts > n)
        bucket[long, k] = (spans(sums, starts[long], starts[long] + n) ^ U(k)) & U(dims - 1)
    cuts = np.unique(np.concatenate([np.flatnonzero(END[data]), offsets]))
    sentence = np.searchsorted(cuts, starts, "right")
    first = np.flatnonzero(np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    return bucket, first, rows[first], starts[first], ends[last]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Fixed: a sentence without any feature has probability 0, so the bias only says how much evidence it takes.
BIAS = -8.0


def evident(z: np.ndarray, bias: float) -> np.ndarray:
    """Probability of a sentence beyond that of one without evidence."""
    base = 1 / (1 + np.exp(-bias))
    return np.maximum(0, (sigmoid(z) - base) / (1 - base))


def fitted(examples: list[tuple[int, float, np.ndarray, np.ndarray]], dims: int, steps: int = 160, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """(label, weight, word buckets, word counts of the sentences) of each document -> model, by Adam on all of them."""
    if not examples:
        return Model(np.zeros(dims, np.float32), BIAS)
    y = np.array([e[0] for e in examples], float)
    c = np.array([e[1] for e in examples], float)
    c /= c.sum()
    bucket = np.concatenate([e[2] for e in examples])
    per = np.concatenate([e[3] for e in examples])
    row = np.repeat(np.arange(len(y)), [len(e[3]) for e in examples])
    sentence = np.repeat(np.arange(len(per)), per)
    names, bucket = np.unique(bucket, return_inverse=True)
    w, b, leak, miss = np.zeros(len(names)), BIAS, -4.0, -3.0
    m, v = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
    docs = len(y)
    for t in range(1, steps + 1):
        z = b + np.bincount(sentence, w[bucket], len(per))
        p = evident(z, b)
        clean = np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), docs))
        q = 1 - clean
        lam, eta = 0.3 * sigmoid(leak), 0.3 * sigmoid(miss)
        prob = np.clip(lam + (1 - lam - eta) * q, 1e-9, 1 - 1e-9)
        g = c * (prob - y) / (prob * (1 - prob))
        gz = (g * (1 - lam - eta) * clean)[row] * sigmoid(z)  # d q / d z_s = clean * sigmoid(z_s), about
        gw = np.bincount(bucket, gz[sentence], len(names)) + decay * w
        g_leak = float((g * (1 - q)).sum() * lam * (1 - lam / 0.3))
        g_miss = float((-g * q).sum() * eta * (1 - eta / 0.3))
        grad = np.concatenate([gw, [g_leak, g_miss]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, leak, miss = w - step[:-2], leak - step[-2], miss - step[-1]
    weights = np.zeros(dims, np.float32)
    weights[names] = w
    return Model(weights, float(b))


EXAMPLES = pa.schema([("label", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary()), ("sentences", pa.binary())])
FEATURES = pa.schema([("bucket", pa.int64()), ("label", pa.int64())])


def speaking(sample: DataFrame, dims: int, evidence: float) -> np.ndarray:
    """Features that more documents with the label have, by the likelihood ratio; ``dims`` of them at most."""

    def features(batch):
        texts = Texts(batch.column("text"))
        label = batch.column("label").to_numpy()
        for i, j, data, offsets in texts.chunks():
            bucket, first, rows, _, _ = parts(data, offsets, dims)
            if len(bucket):
                row = np.repeat(rows, np.diff(np.append(first, len(bucket))))
                pair = np.unique(np.repeat(row, KINDS) * dims + bucket.ravel())
                pair = pair[pair % dims > 0]
                yield [pair % dims, label[i:j][pair // dims].astype(np.int64)]

    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(size.get(1, 0)), float(size.get(0, 0))
    if not n1 or not n0:
        return np.zeros(dims, bool)
    a, b = F.col("a"), F.col("b")
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    row = lambda x, n: part(x, F.lit(n)) + part(F.lit(n) - x, F.lit(n))
    found = (
        sample.select("label", "text")
        .mapInArrow(lambda it: batches(it, FEATURES, features), "bucket long, label long")
        .groupBy("bucket")
        .agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        .where((a / n1 > b / n0) & (2 * (row(a, n1) + row(b, n0) - row(a + b, n1 + n0)) >= evidence))
        .select("bucket")
        .collect()
    )
    chosen = np.zeros(dims, bool)
    chosen[[r.bucket for r in found]] = True
    return chosen


def labelled(docs: DataFrame, labels: DataFrame, label: Column, values: list[int], per_value: int, longest: int) -> tuple[dict[int, int], DataFrame]:
    """How many documents have each label, and label, doc_id, text of at most ``per_value`` of each label, those of the least hash of
    doc_id, that aren't held out.

    A document labelled more than once counts with its least label; of rows that repeat a doc_id the text of the least hash is
    taken; texts of more than ``longest`` characters aren't learnt from.  So the sample's rows and bytes are bounded."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(values)).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in values:
        one = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_value)
        chosen = one if chosen is None else chosen.union(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    # at most len(values) * per_value ids are broadcast
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("r"))
    return totals, found.select("r.label", "doc_id", "r.text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 5000, dims: int = 1 << 20, evidence: float = 15.0, longest: int = 1 << 20) -> Model:
    """Model from labels (doc_id, ``label`` 0/1) of documents that aren't held out, chosen by ``labelled``: at most ``per_class`` of
    each class, of at most ``longest`` characters.  Rows without label or doc_id aren't used; without any row every score is near 0."""
    totals, found = labelled(docs, labels, F.col(label), [0, 1], per_class, longest)
    # the sample's texts stay in the shared folder
    sample = settled(found)
    speaks = speaking(sample, dims, evidence)

    def numbers(batch):
        texts = Texts(batch.column("text"))
        for i, j, data, offsets in texts.chunks():
            bucket, first, rows, _, _ = parts(data, offsets, dims)
            use = speaks[bucket]
            per = np.add.reduceat(use.sum(1), first) if len(first) else np.zeros(0, np.int64)
            bounds = np.searchsorted(rows, np.arange(j - i + 1))
            flat, ends = bucket[use].astype(np.int32), np.concatenate([[0], np.cumsum(per)])
            w = [flat[ends[a] : ends[b]].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            s = [per[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield [batch.column("label").slice(i, j - i).cast(pa.int64()), batch.column("doc_id").slice(i, j - i), w, s]

    rows = sample.mapInArrow(lambda it: batches(it, EXAMPLES, numbers), "label long, doc_id long, words binary, sentences binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.words)))
    taken = {y: max(1, sum(r.label == y for r in rows)) for y in (0, 1)}
    return fitted([(r.label, totals[r.label] / taken[r.label], np.frombuffer(r.words, np.int32).astype(np.int64), np.frombuffer(r.sentences, np.int32)) for r in rows], dims)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()), ("worst_score", pa.float64()), ("offending", pa.list_(pa.int64()))])


def document_scores(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Noisy-or of each row; probability, row, first and last byte of each sentence."""
    bucket, first, rows, begin, end = parts(data, offsets, len(model.weights))
    p = evident(model.bias + np.add.reduceat(model.weights[bucket].sum(1, dtype=float), first), model.bias) if len(first) else np.zeros(0)
    q = 1 - np.exp(np.bincount(rows, np.log1p(-np.minimum(p, 1 - 1e-12)), len(offsets) - 1))
    return q, p, rows, begin, end


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, held_out, score (noisy-or; 0 for a null or
    empty text or one without words), predicted, n_sentences, worst_score, offending: first and last byte, in turn, of the
    sentences that reach the threshold by themselves.  Repeated rows get the same result; a long text is scored whole."""

    def one(batch):
        texts = Texts(batch.column("text"))
        for i, j, data, offsets in texts.chunks():
            n = j - i
            q, p, rows, begin, end = document_scores(model, data, offsets)
            worst = np.zeros(n)
            np.maximum.at(worst, rows, p)
            bad = np.flatnonzero(p >= threshold)
            counts = np.bincount(rows[bad], minlength=n)
            flat = np.stack([begin[bad] - offsets[rows[bad]], end[bad] - offsets[rows[bad]]], 1).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 2 * np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int64()))
            yield [batch.column("doc_id").slice(i, n), np.clip(q, 0, 1), np.bincount(rows, minlength=n), worst, lists]

    return (
        bounded_batches(docs)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda it: batches(it, SCORED, one), "doc_id long, score double, n_sentences long, worst_score double, offending array<long>")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_score", "offending")
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 5000) -> DataFrame:
    """``score`` with a model fitted to ``labels``."""
    bounded_batches(docs)
    return score(docs, fit(docs, labels, per_class=per_class), threshold)


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of docs, with all their columns, whose score stays below the threshold; a null or empty text stays.  One pass, no shuffle."""

    def one(it):
        for batch in it:
            texts, keep = Texts(batch.column(batch.schema.get_field_index("text"))), []
            for i, j, data, offsets in texts.chunks():
                keep.append(document_scores(model, data, offsets)[0] < threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return bounded_batches(docs).mapInArrow(one, docs.schema)
