"""Removal of repeated passages: sampled suffixes are sorted out externally, and repeats are induced from them.

A byte goes if a string of ``length`` bytes that covers it also starts at another place, in the same document or another one.
Full induced sorting carries a tuple for each suffix, 8 bytes and more for every byte of text through several disk passes;
here only suffixes at *sampled* positions are carried, and what lies between them is induced:

1. *Sample*.  Each window of ``length`` bytes names one position: the leftmost smallest hash among its k-byte strings.  It
   depends on the window's bytes alone, so equal windows name the same position wherever they stand.  About 2 in
   (length - k) positions are named, each by a run of neighbouring windows, from ``first`` to ``last``.
2. *Sort out*.  The suffix tuple of a sample is (hash of its k bytes, hash of all bytes of its run of windows).  Spark's
   aggregation, which sorts and spills to disk, counts tuples and their first parts.  A first part seen once rules out a
   repeat in any window of the run; a whole tuple seen twice makes all of them repeats.  Counting comes first on the map side.
3. *Induce*.  Samples in between (they stand near an end of a repeat, or near an edit) send the bytes of their run to the
   group of their first part.  The windows of the run are the suffixes induced from the sample; those of equal hash in a
   group have a common prefix of at least ``length``.  Groups of up to ``small`` samples are collected to a row each;
   larger groups are dealt out again by the windows' own hashes and counted there, however large they are.
4. *Apply*.  Repeated windows of a document are merged to spans and its other bytes hashed or kept.

Texts longer than a segment are handled in overlapping segments, so memory is bounded.  Hashes have 64 bits; in step 3 two
windows must agree in the first part's hash and their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnum import Texts, U, batches, prefix, signed, spans
from .common import bounded_batches, settled

SEGMENT = 1 << 18


def segments(texts: Texts, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of rows; a text beyond a segment comes in parts that overlap by length - 1: first row, first byte, bytes, offsets."""
    for i, _, data, offsets in texts.chunks(SEGMENT):
        if len(data) <= 2 * SEGMENT:
            yield i, 0, data, offsets
        else:
            for at in range(0, len(data) - length + 1, SEGMENT):
                part = data[at : at + SEGMENT + length - 1]
                yield i, at, part, np.array([0, len(part)])


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Row, position, first and last window (all within the row), hash of the k bytes, hash of the run of windows."""
    n, w = len(data), length - k + 1
    sizes = np.diff(offsets)
    if n < length or sizes.max() < length:
        return None
    sums = prefix(data)
    at = np.arange(n - k + 1)
    grams = spans(sums, at, at + k)
    least = (grams & U(0xFFFFFFFFFF000000)) | at.astype(U)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if w > width:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    here = np.zeros(n + 1, np.int32)
    full = sizes >= length
    np.add.at(here, offsets[:-1][full], 1)
    np.add.at(here, offsets[1:][full] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(here[:-1])[: len(least)])
    named = (least[windows] & U(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last, pos = windows[new], windows[np.concatenate([new[1:] - 1, [len(windows) - 1]])], named[new]
    row = np.searchsorted(offsets, first, "right") - 1
    base = offsets[row]
    whole = spans(sums, first, last + length) ^ ((pos - first).astype(U) * U(0xA24BAED4963EE407))
    return row, pos - base, first - base, last - base, grams[pos], whole


SAMPLES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("part", pa.int64()), ("whole", pa.int64())])


def samples(docs: DataFrame, length: int, k: int) -> DataFrame:
    def one(batch):
        ids, th = batch.column("doc_id"), batch.column("th")
        for i, at, data, offsets in segments(Texts(batch.column("text")), length):
            if found := sampled(data, offsets, length, k):
                row, _, first, last, part, whole = found
                rows = pa.array(row + i)
                yield [ids.take(rows), th.take(rows), first + at, last + at, signed(part), signed(whole)]

    return docs.select("doc_id", "th", "text").mapInArrow(lambda it: batches(it, SAMPLES, one), "doc_id long, th long, first long, last long, part long, whole long")


CONTEXTS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])
REPEATED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
WINDOWS = pa.schema([("part", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64())])


def contexts(docs: DataFrame, unsure: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of each unsure sample cover."""

    def one(batch):
        texts = Texts(batch.column("text"))
        ids, th, runs = batch.column("doc_id"), batch.column("th"), batch.column("runs")
        flat = runs.flatten()
        row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        part, first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("part", "first", "last"))
        for i in range(0, len(row), 4096):
            s = slice(i, i + 4096)
            a = texts.offsets[row[s]] + first[s]
            raw = [texts.data[x:y].tobytes() for x, y in zip(a, a + (last[s] - first[s]) + length, strict=True)]
            rows = pa.array(row[s])
            yield [part[s], ids.take(rows), th.take(rows), first[s], raw]

    runs = unsure.groupBy("doc_id", "th").agg(F.collect_list(F.struct("part", "first", "last")).alias("runs"))
    text = docs.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "text")
    return text.join(runs, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select("doc_id", "th", "text", "runs").mapInArrow(lambda it: batches(it, CONTEXTS, one), "part long, doc_id long, th long, first long, bytes binary")


def window_hashes(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of each run, and its run."""
    sizes = np.array([len(x) for x in raw])
    count = sizes - length + 1
    sums = prefix(np.frombuffer(b"".join(raw), np.uint8))
    run = np.repeat(np.arange(len(raw)), count)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])[run] + np.arange(len(run)) - np.concatenate([[0], np.cumsum(count)[:-1]])[run]
    return spans(sums, start, start + length), run


def merged(same: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first and last window of each stretch of neighbours in a run that are all repeated."""
    at = np.flatnonzero(same)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])])
    return at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]


def in_small_groups(it: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans among the samples of each ``part``, a row with all of them; groups are taken together until enough."""
    for batch in it:
        part, groups = batch.column("part").to_numpy(), batch.column("samples")
        flat = groups.flatten()
        ends = groups.offsets.to_numpy() - groups.offsets[0].as_py()
        ids, th, first, raw = (flat.field(c) for c in ("doc_id", "th", "first", "bytes"))
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + 512, "right")) - 1)
            x, n = int(ends[i]), int(ends[j] - ends[i])
            hashes, run = window_hashes(raw.slice(x, n).to_pylist(), length)
            key = np.repeat(part[i:j], np.diff(ends[i : j + 1])).view(U)[run] ^ hashes
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            a, b = merged(counts[inverse] > 1, run)
            if len(a):
                begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                r = run[a]
                at, base = pa.array(r + x), first.slice(x, n).to_numpy()[r]
                yield pa.RecordBatch.from_arrays([ids.take(at), th.take(at), pa.array(base + a - begin[r]), pa.array(base + b - begin[r] + length)], schema=REPEATED)
            i = j


def in_large_groups(rows: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: windows are counted by their hash, counts first on the map side."""

    def one(batch):
        part, ids, th, first = (batch.column(c) for c in ("part", "doc_id", "th", "first"))
        raw = batch.column("bytes").to_pylist()
        for i in range(0, len(raw), 512):
            hashes, run = window_hashes(raw[i : i + 512], length)
            begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = pa.array(run + i)
            yield [part.take(at), signed(hashes), ids.take(at), th.take(at), first.to_numpy()[run + i] + np.arange(len(run)) - begin[run]]

    windows = rows.mapInArrow(lambda it: batches(it, WINDOWS, one), "part long, hash long, doc_id long, th long, start long")
    often = windows.groupBy("part", "hash").agg(F.count("*").alias("n")).where("n > 1").select("part", "hash")
    return windows.join(often, ["part", "hash"], "left_semi").select("doc_id", "th", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = 400, k: int = 64, small: int = 2000) -> DataFrame:
    """doc_id, th (hash of the text), start, end: spans, which may overlap, of bytes that repeated strings cover.

    docs: doc_id, th, text."""
    found = settled(samples(docs, length, k))
    counts = found.groupBy("part", "whole").agg(F.count("*").alias("n"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("total")).where("total > 1")
    marks = settled(counts.join(totals, "part"))
    marked = settled(found.join(marks, ["part", "whole"]))
    sure = marked.where("n > 1").select("doc_id", "th", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    # a group's tuples that were all seen twice or more have no windows in doubt; single ones are compared with one of each
    # cut, so that joins with it have two plain sides and a part with very many samples can be split
    kinds = settled(marks.groupBy("part").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    one_of_each = marked.where("n > 1").groupBy("part", "whole").agg(F.min(F.struct("doc_id", "th", "first", "last")).alias("m")).select("part", "m.*")
    unsure = marked.where("n = 1").select("part", "doc_id", "th", "first", "last")
    in_doubt = settled(unsure.union(one_of_each).join(kinds, "part"))
    rows = settled(contexts(docs, in_doubt.drop("kinds").dropDuplicates(), length))
    large = settled(rows.groupBy("part").agg(F.count("*").alias("n")).where(f"n > {small}").select("part"))
    # a group is one row: where a plain repartition by part follows a join by part, Spark drops it and may read that join's
    # shuffle locally, which tears groups
    groups = rows.join(large, "part", "left_anti").groupBy("part").agg(F.collect_list(F.struct("doc_id", "th", "first", "bytes")).alias("samples"))
    grouped = groups.mapInArrow(lambda it: in_small_groups(it, length), "doc_id long, th long, start long, end long")
    return sure.union(grouped).union(in_large_groups(rows.join(large, "part", "left_semi"), length))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64())), ("text_left", pa.binary())])


def without_repeats(docs: DataFrame, length: int = 400, k: int = 64, small: int = 2000, keep_bytes: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    removed (start and end of each span in turn) and, with ``keep_bytes``, text_left as bytes.

    A null text counts as empty; texts shorter than ``length`` lose nothing.  Rows that repeat a whole row are other places.
    doc_id may be null.  A cut may split a character of several bytes, so what is left stays binary.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))

    def one(batch):
        texts = Texts(batch.column("text"))
        rows = batch.column("spans")
        out = [], [], [], [], [], []
        for r in range(len(texts)):
            data = texts.data[texts.offsets[r] : texts.offsets[r + 1]]
            n, edges, left = len(data), np.zeros(0, np.int64), data
            if rows[r].is_valid and len(rows[r].values):
                v = rows[r].values
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, v.field("start").to_numpy(), 1)
                np.add.at(depth, v.field("end").to_numpy(), -1)
                gone = np.cumsum(depth[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = data[~gone]
            for c, x in zip(out, (n, n - len(left), len(edges) // 2, hashlib.sha256(left.tobytes()).hexdigest(), edges.tolist(), left.tobytes() if keep_bytes else None), strict=True):
                c.append(x)
        yield [batch.column("doc_id"), *out]

    spans_of = (
        repeated_spans(docs, length, k, small)
        .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "start", "end")
        .groupBy("d", "t")
        # a set: rows that repeat a row find the same spans, which are told apart on the map side already
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )
    return (
        docs.join(spans_of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(lambda it: batches(it, RESULT, one), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>, text_left binary")
    )
