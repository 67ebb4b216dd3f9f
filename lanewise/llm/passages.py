"""Removal of passages that an earlier document has: seed on winnowed anchors, extend both ways, drop maximal repeats.

A window is ``length`` consecutive words.  A word goes if a window that covers it also starts in a document with a smaller
doc_id.

1. *Winnow.*  Each window names as its anchor the leftmost of its k-word strings with the least hash.  That depends on the
   window's words alone, so equal windows name equal anchors at the same distance from their start, wherever they stand.
   About 2 in (length - k + 2) positions are anchors; each is named by one run of neighbouring windows, ``first`` to ``last``.
2. *Seed.*  Anchors meet by hash.  The least and greatest doc_id of each are found by partial aggregation; only anchors of two
   documents or more go on.
3. *Extend.*  An anchor is extended as far as the windows that name it reach, to both sides at once: equal hashes of all words
   from ``first`` to ``last`` + length are one kind of extension.  Where a kind stands in a document, the whole stretch is a
   repeat in every later one.  Kinds of one anchor that differ (near an end of a passage, or an edit) may still agree in
   some windows: their first documents extend the anchor by every number of words to the left and the rest to the right,
   which is a hash for each window, and the least doc_id of each hash decides.  That is linear in the occurrences of an anchor,
   where holding each against each other would be quadratic for a phrase that many documents share.
4. *Merge.*  Stretches and windows of a document that touch or overlap are its maximal repeats; their words are dropped.

No occurrence is capped or sampled; the hot groups are aggregated before they are shuffled, and joins have two plain sides that
Spark can split.  Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnum import Texts, U, batches, grams, hashed_words, joined_words, signed, spans, sums_of, words
from .common import bounded_batches, settled


def anchors(h: np.ndarray, rows: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, first and last window that name it, and its place from the first one."""
    n = len(h) - length + 1
    if n < 1:
        return (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 3
    gram = grams(h, k)
    at = np.flatnonzero(rows[:n] == rows[length - 1 :])
    place = at + np.lib.stride_tricks.sliding_window_view(gram, length - k + 1).argmin(1)[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)])
    first, last = at[new], at[np.concatenate([new[1:], [len(at)]])[: len(new)] - 1]
    return gram[place[new]], first, last, place[new] - first


SEEDS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("th", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("kind", pa.int64())])


def seeds(docs: DataFrame, length: int, k: int) -> DataFrame:
    """A row for each anchor of docs (doc, th, text): its hash, first window, number of windows, hash of its whole extension."""

    def one(batch):
        ids, th = batch.column("doc"), batch.column("th")
        for i, j, data, offsets in Texts(batch.column("text")).chunks():
            _, _, rows, h = hashed_words(data, offsets)
            gram, first, last, place = anchors(h, rows, length, k)
            kind = spans(sums_of(h), first, last + length) ^ ((place + 1).astype(U) * U(0xA24BAED4963EE407))
            row = rows[first]
            base = np.searchsorted(rows, np.arange(j - i))[row]
            at = pa.array(row + i)
            yield [signed(gram), ids.take(at), th.take(at), pa.array((first - base).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), signed(kind)]

    return docs.mapInArrow(lambda it: batches(it, SEEDS, one), "anchor long, doc long, th int, first int, n int, kind long")


WINDOWS = pa.schema([("window", pa.int64()), ("doc", pa.int64()), ("th", pa.int32()), ("start", pa.int32())])


def extended(docs: DataFrame, unsure: DataFrame, length: int) -> DataFrame:
    """A row for each window of the unsure seeds: hash of anchor and words, and where it starts."""

    def one(batch):
        ids, th, runs = batch.column("doc"), batch.column("th"), batch.column("runs")
        for i, j, data, offsets in Texts(batch.column("text")).chunks():
            _, _, rows, h = hashed_words(data, offsets)
            sums, base = sums_of(h), np.searchsorted(rows, np.arange(j - i))
            part = runs.slice(i, j - i)
            flat = part.flatten()
            row = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
            anchor, first, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "first", "n"))
            each = np.repeat(np.arange(len(n)), n)
            start = first[each] + np.arange(len(each)) - (np.cumsum(n) - n)[each]
            a = base[row[each]] + start
            window = spans(sums, a, a + length) ^ (anchor.view(U)[each] * U(0xD6E8FEB86659FD93))
            at = pa.array(row[each] + i)
            yield [signed(window), ids.take(at), th.take(at), pa.array(start.astype(np.int32))]

    runs = unsure.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("anchor", "first", "n")).alias("runs"))
    held = docs.join(runs, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t"))).select("doc", "th", "text", "runs")
    return held.mapInArrow(lambda it: batches(it, WINDOWS, one), "window long, doc long, th int, start int")


def repeats(docs: DataFrame, length: int, k: int) -> DataFrame:
    """doc, th, span (start * 2^32 + end, in words) of stretches that an earlier document has; they may overlap."""
    span = lambda start, end: (F.shiftleft(start.cast("long"), 32) + end).alias("span")
    found = seeds(docs.where("doc is not null"), length, k)
    shared = settled(found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor"), sweep=True)
    live = settled(found.join(shared, "anchor"), sweep=True)
    kinds = settled(live.groupBy("anchor", "kind").agg(F.min("doc").alias("lo")), sweep=True)
    differ = settled(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"), sweep=True)
    placed = settled(live.join(kinds, ["anchor", "kind"]).select("anchor", "doc", "th", "first", "n", "lo"), sweep=True)
    sure = placed.where("doc > lo").select("doc", "th", span(F.col("first"), F.col("first") + F.col("n") + (length - 1)))
    unsure = settled(placed.where("doc = lo").join(differ, "anchor").select("anchor", "doc", "th", "first", "n"), sweep=True)
    windows = settled(extended(docs, unsure, length), sweep=True)
    earlier = settled(windows.groupBy("window").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("window", "lo"), sweep=True)
    later = windows.join(earlier, "window").where("doc > lo").select("doc", "th", span(F.col("start"), F.col("start") + length))
    return sure.union(later)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64())), ("text_left", pa.string())])


def without_passages(docs: DataFrame, length: int = 13, k: int = 5, keep_text: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, n_words, n_removed, kept_sha256, removed (first
    word and end of each maximal repeat in turn) and, with ``keep_text``, text_left: the kept words joined by single spaces.

    Words are maximal stretches without ASCII white space, taken as they are.  Null, empty and blank texts have no words; texts
    of fewer than ``length`` words lose none.  Of rows that repeat a doc_id none is earlier than the others, whatever their
    texts; a row without doc_id is neither earlier nor later than any other and stays whole.  Long texts are held whole by
    their task, at about 60 bytes a word.
    """
    if not 0 < k <= length:
        raise ValueError("an anchor has 1 to length words")
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.hash(F.coalesce("text", F.lit(""))))

    def one(batch):
        texts, removed = Texts(batch.column("text")), batch.column("spans")
        out = [], [], [], [], []
        for r in range(len(texts)):
            data = texts.data[texts.offsets[r] : texts.offsets[r + 1]]
            starts, ends, _ = words(data, np.array([0, len(data)]))
            gone, edges, n = np.zeros(len(data), bool), np.zeros(0, np.int64), 0
            if removed[r].is_valid and len(removed[r].values):
                span = removed[r].values.to_numpy()
                depth = np.zeros(len(starts) + 1, np.int32)
                np.add.at(depth, span >> 32, 1)
                np.add.at(depth, span & 0xFFFFFFFF, -1)
                covered = np.cumsum(depth[:-1]) > 0
                n = int(covered.sum())
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                for a, b in edges.reshape(-1, 2):
                    gone[starts[a] : ends[b - 1]] = True
            left = joined_words(data, gone)
            for column, x in zip(out, (len(starts), n, hashlib.sha256(left).hexdigest(), edges.tolist(), left.decode() if keep_text else None), strict=True):
                column.append(x)
        yield [batch.column("doc"), *out]

    found = repeats(docs, length, k).select(F.col("doc").alias("d"), F.col("th").alias("t"), "span").groupBy("d", "t").agg(F.collect_set("span").alias("spans"))
    return (
        docs.join(found, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t")), "left")
        .select("doc", "text", "spans")
        .mapInArrow(lambda it: batches(it, RESULT, one), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<long>, text_left string")
    )
