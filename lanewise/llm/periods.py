"""Runs of repeated words within a text: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q, of at least max(``least``, 2 q) words, that no neighbouring
word extends keeping the period.

1. *Narrow down.*  A run of at least ``least`` words repeats k = least / 2 words in a row, q words further on, and k-grams that
   stand twice cover all of it.  So only stretches covered by repeated k-grams are searched; within a stretch the same holds
   again, until nothing more goes.  This is one sort of hashes for each pass over a batch of texts, and loses no run.
2. *Divide and conquer.*  Words of a stretch are interned as small integers.  A stretch is halved; Z-functions of both halves
   and of their mirror images give, for every period p, how far words p apart agree forwards and backwards from the middle.
   Where both add up to p or more, there is a repetition across the middle, extended both ways as far as the halves go.
   One that would grow beyond the halves crosses the middle of a larger stretch and is found there.
3. *Deduplicate.*  Of the repetitions of one interval the smallest period stays.

A text is worked on by one task; all texts of a batch share the first step.  Memory is about 60 bytes a word of a batch or of
the longest text.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnum import Texts, U, batches, grams, hashed_words, joined_words, mix
from .common import bounded_batches


def z_values(s: list[int]) -> list[int]:
    """How many elements s[i:] has in common with s, for each i."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def repetitions(s: list[int], least: int = 12) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of every run of s; elements are not negative."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        u, v = s[lo:mid], s[mid:hi]
        a, b, x = len(u), len(v), u[::-1]
        ahead = np.array(z_values(v + [-1] + u + v))
        behind = np.array(z_values(x + [-2] + v[::-1] + x))
        # words at mid and mid + p, then at mid - p and mid: agreement forwards, and backwards from the words before them
        p = np.arange(1, b + 1)
        right = (p, np.append(ahead[1:b], 0), behind[a + 1 : a + 1 + b][::-1], p)
        p = np.arange(1, a + 1)
        left = (p, ahead[b + 1 : b + 1 + a][::-1], np.append(behind[1:a], 0), 0 * p)
        for p, forward, backward, shift in (right, left):
            for i in np.flatnonzero(forward + backward >= np.maximum(p, least - p)).tolist():
                q = int(p[i])
                end = mid + int(forward[i] + shift[i])
                start = end - q - int(forward[i] + backward[i])
                # a larger stretch has those that go on beyond this one
                if (start == lo and lo > 0 and s[lo - 1] == s[lo - 1 + q]) or (end == hi and hi < len(s) and s[hi] == s[hi - q]):
                    continue
                if found.get((start, end), q + 1) > q:
                    found[start, end] = q
    return found


def stretches(h: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the stretches, each within a row, that hold all runs of at least ``least`` words."""
    k = least // 2
    gram = grams(h, k)
    if not len(gram):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(gram)] == rows[k - 1 :])
    group = rows[at].astype(U)
    while True:
        key = mix(gram[at] + mix(group))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        depth = np.zeros(len(h) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + k, -1)
        inside = np.cumsum(depth[:-1]) > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
        starts = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (rows[1:] != rows[:-1])
        ends = np.flatnonzero(last) + 1
        if twice.all():
            long = ends - starts >= least
            return starts[long], ends[long]
        group = (np.searchsorted(starts, at, "right") - 1).astype(U)


RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, text_left string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(RUN)), ("text_left", pa.string())])


def with_runs(docs: DataFrame, least: int = 12, keep_text: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, n_words, n_runs, start, length, period and
    exponent_milli of the longest run (ties: smallest start, then period; null without runs), runs_sha256, collapsed_sha256,
    runs (by start, then period) and, with ``keep_text``, text_left: the words that stand in no run after its first period.

    Words are maximal stretches without ASCII white space.  Null, empty and blank texts have no words, no runs and the hash of
    the empty string twice.  doc_id may be null or repeated; every row has its own result.  ``least`` is 4 or more and even.
    """
    if least < 4 or least % 2:
        raise ValueError("least must be an even number from 4 on")

    def one(batch):
        ids = batch.column("doc_id")
        for i, j, data, offsets in Texts(batch.column("text")).chunks():
            starts, ends, rows, h = hashed_words(data, offsets)
            first = np.searchsorted(rows, np.arange(j - i + 1))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
            gone = np.zeros(len(data) + 1, np.int32)
            for lo, hi in zip(*(x.tolist() for x in stretches(h, rows, least)), strict=True):
                row = rows[lo]
                words = np.unique(h[lo:hi], return_inverse=True)[1].tolist()
                for (a, b), q in repetitions(words, least).items():
                    runs[row].append((lo + a - int(first[row]), b - a, q))
                    gone[starts[lo + a + q]] += 1
                    gone[ends[lo + b - 1]] -= 1
            # of white space between dropped words, too, which joined_words doesn't mind
            gone = np.cumsum(gone[:-1]) > 0
            out = [[] for _ in SCHEMA.names[1:]]
            for r in range(j - i):
                runs[r].sort(key=lambda x: (x[0], x[2]))
                s = slice(offsets[r], offsets[r + 1])
                left = joined_words(data[s], gone[s])
                best = max(runs[r], key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs[r])
                values = (int(first[r + 1] - first[r]), len(runs[r]), *best, 1000 * best[1] // best[2] if runs[r] else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                for column, x in zip(out, (*values, [dict(zip(("start", "length", "period"), x, strict=True)) for x in runs[r]], left.decode() if keep_text else None), strict=True):
                    column.append(x)
            yield [ids.slice(i, j - i), *out]

    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: batches(it, SCHEMA, one), RESULT)
