"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the others by a heap over linked bytes.

Texts are cut into pre-tokens by character classes over a chunk at once (the rules of ``PATTERN``, which is the only one
supported).  Distinct pre-tokens of a chunk are looked up together: first in a minimal perfect hash of the vocabulary (hash
and displace; one slot for each token, the bytes compared), then in the worker's memory of earlier misses, and only then
merged byte by byte.  Ids are spread back over the chunk and cut by row.  A rank file of the usual form is read once on the
driver; its tables, whose size depends on the vocabulary alone, go to the tasks with the function.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnum import Texts, U, batches, mix, prefix, spans
from .common import bounded_batches

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, WHITE = range(4)
#: The characters of Unicode's property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
REMEMBERED = 200_000


@lru_cache(1)
def classes() -> np.ndarray:
    kind = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    kind[WHITE_SPACE] = WHITE
    return kind


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each pre-token of the rows' UTF-8 bytes, in order; a pre-token ends where the next one begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    if not n:
        return lead
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[chars]
    rows = np.searchsorted(lead, offsets)
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[rows] = True
    white = kind == WHITE
    before = np.empty(n, np.uint8)
    before[1:], before[0] = kind[:-1], 255
    first = edge[:n] | (kind != before)  # of a run of one class
    start = first.copy()
    # a blank right before another class belongs to what follows
    blank = np.zeros(n, bool)
    blank[1:] = (chars[:-1] == 32) & ~edge[1:n]
    start &= white | ~blank
    # of several white characters before another class the last one stands alone
    followed = np.zeros(n, bool)
    followed[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    start |= followed
    # contractions
    for i in np.flatnonzero((chars == 39) & start):
        stop = int(rows[np.searchsorted(rows, i, "right")]) if rows[-1] > i else n
        tail = chars[i + 1 : min(i + 3, stop)]
        if not len(tail):
            continue
        two = "".join(map(chr, tail))
        size = 2 if two in ("re", "ve", "ll") else 1 if two[0] in "stmd" else 0
        if size:
            start[i + 1 : i + 1 + size] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return lead[start]


class Vocabulary:
    """Tables of a rank file: tokens by id, and a minimal perfect hash from a token's bytes to its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(x) for x in tokens])
        self.sizes = np.diff(self.ends, prepend=0)
        present = np.flatnonzero(self.sizes > 0)
        begin = self.ends[present] - self.sizes[present]
        self._place(spans(prefix(self.blob), begin, self.ends[present]), present)

    def _place(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        """Displace each bucket until its keys fall into free slots, large buckets first; a bucket of one key names a slot."""
        n = len(hashes)
        if len(np.unique(hashes)) != n:
            raise ValueError("two tokens share a hash")
        buckets = max(1, n // 2)
        of = (hashes % U(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        slot_of, free = np.full(n, -1), np.ones(n, bool)
        self.shift = np.zeros(buckets, np.int64)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[bounds[b] : bounds[b + 1]]
            if sizes[b] < 2:
                break
            d = 1
            while True:  # 32 displacements at a time
                slots = (mix(hashes[keys] + np.arange(d, d + 32, dtype=U)[:, None]) % U(n)).astype(np.int64)
                good = [i for i in np.flatnonzero(free[slots].all(1)) if len(set(slots[i].tolist())) == len(keys)]
                if good:
                    break
                d += 32
            free[slots[good[0]]], slot_of[keys], self.shift[b] = False, slots[good[0]], d + good[0]
        open_slots = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            s = next(open_slots)
            slot_of[order[bounds[b]]], self.shift[b] = s, -1 - s
        self.slot_id = np.empty(n, np.int64)
        self.slot_id[slot_of] = ids

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of data[start:start + size], -1 for what isn't in the vocabulary."""
        n = len(self.slot_id)
        d = self.shift[(hashes % U(len(self.shift))).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, (mix(hashes + d.astype(U)) % U(n)).astype(np.int64))
        ids = self.slot_id[slot]
        same = np.flatnonzero(self.sizes[ids] == sizes)
        _, mine = gather(data, starts[same], sizes[same])
        row, its = gather(self.blob, self.ends[ids[same]] - sizes[same], sizes[same])
        wrong = np.zeros(len(same), bool)
        wrong[row[mine != its]] = True
        out = np.full(len(hashes), -1)
        out[same[~wrong]] = ids[same[~wrong]]
        return out

    def ranks(self) -> dict[bytes, int]:
        raw = self.blob.tobytes()
        return {raw[e - s : e]: i for i, (e, s) in enumerate(zip(self.ends.tolist(), self.sizes.tolist(), strict=True)) if s}


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start:start + size] of all rows, one after the other, and the row of each element."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    return row, data[np.arange(len(row)) + (starts - before)[row]]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of the least rank, the leftmost first, is joined until none is in the vocabulary."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i], before[end] = end, i
        if end < n and (r := ranks.get(word[i : after[end]])) is not None:
            heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes rows of bytes; made once in each task, remembers misses up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.ranks, self.memory = vocabulary, vocabulary.ranks(), {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and each row's first one (and the end)."""
        starts = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = spans(prefix(data), starts, ends)
        code, distinct = pd.factorize(hashes)
        at = np.empty(len(distinct), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]
        s, size = starts[at], (ends - starts)[at]
        known = self.vocabulary.find(distinct, data, s, size)
        ids, counts = known, np.ones(len(distinct), np.int64)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            raw, memory, several = data.tobytes(), self.memory, []
            for a, n in zip(s[missing].tolist(), size[missing].tolist(), strict=True):
                word = raw[a : a + n]
                found = memory.get(word)
                if found is None:
                    found = merge(word, self.ranks)
                    if n <= 64:
                        memory[word] = found
                several.append(found)
            counts[missing] = [len(x) for x in several]
            first = np.cumsum(counts) - counts
            flat = np.empty(int(counts.sum()), np.int64)
            flat[first[known >= 0]] = known[known >= 0]
            row = np.repeat(missing, counts[missing])
            flat[(first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts[missing]) - counts[missing], counts[missing]))] = np.concatenate(several)
            ids = flat
        first = np.cumsum(counts) - counts
        per = counts[code]
        _, out = gather(ids, first[code], per)
        total = np.concatenate([[0], np.cumsum(per)])
        return out, total[np.searchsorted(starts, offsets)]


def decoded(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids of all rows, and each row's first byte (and the end)."""
    sizes = vocabulary.sizes[ids]
    _, data = gather(vocabulary.blob, vocabulary.ends[ids] - sizes, sizes)
    return data, np.concatenate([[0], np.cumsum(sizes)])[bounds]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, with_ids: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (the bytes that the ids give back) and, with ``with_ids``, ids.

    A null text counts as empty: no ids, hashes of no bytes.  Nothing is shuffled; repeated rows are encoded alike."""
    if pattern != PATTERN:
        raise ValueError("only PATTERN is supported")
    vocabulary = Vocabulary(path)

    def run(it):
        encoder = Encoder(vocabulary)

        def one(batch):
            texts = Texts(batch.column("text"))
            for i, j, data, offsets in texts.chunks():
                ids, bounds = encoder(data, offsets)
                back, ends = decoded(vocabulary, ids, bounds)
                raw, small = ids.astype("<u4"), bounds.tolist()
                shas = [hashlib.sha256(raw[a:b].data).hexdigest() for a, b in zip(small, small[1:], strict=False)]
                again = [hashlib.sha256(back[a:b].data).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(raw.astype(np.int32))) if with_ids else pa.nulls(j - i, pa.list_(pa.int32()))
                yield [batch.column("doc_id").slice(i, j - i), np.diff(bounds), shas, again, lists]

        return batches(it, ENCODED, one)

    out = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    return out if with_ids else out.drop("ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (from the bytes of ids, invalid ones replaced) of each row of a table with doc_id and ids."""
    vocabulary = Vocabulary(path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def one(batch):
        ids = batch.column("ids")
        bounds = np.concatenate([[0], np.cumsum(np.array(ids.value_lengths().fill_null(0)))])
        data, ends = decoded(vocabulary, ids.flatten().to_numpy().astype(np.int64), bounds)
        yield [batch.column("doc_id"), [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]]

    return bounded_batches(encoded).select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lambda it: batches(it, schema, one), "doc_id long, text string")
