"""Vectorised work on the bytes of a column of texts inside Arrow tasks.

Operators of this subpackage that aren't bound to built-in functions get their texts as Arrow record batches
(``mapInArrow``), see them as one byte array with offsets, and work in chunks of about ``CHUNK`` bytes, so that memory is
bounded by a chunk or by the longest single text.  Hashes are polynomial hashes modulo 2^64 of a random substitution of the
bytes, finished by a mixing step; they depend on the hashed bytes only, so equal texts hash alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
UNBASE = U(pow(int(BASE), -1, 1 << 64))

#: ASCII white space that separates words: space and the characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


CODE = mix(np.arange(1, 257, dtype=U) * BASE) | U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i from 0 to n, kept by the worker."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, UNBASE)):
            p = np.full(max(n, CHUNK) + 4097, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(CODE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; they don't depend on where the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Texts:
    """A column of texts as bytes; null is the empty text."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n, (_, offsets, data) = len(column), column.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def chunks(self, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, next chunk's first row, bytes, and offsets from 0: at most ``limit`` bytes, or a single row."""
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + limit, "right")) - 1)
            j = min(j, n, i + 65536)
            yield i, j, self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]
            i = j


#: Bytes of plain words: ASCII letters and digits, and all bytes of other characters.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, within: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a kind (not white space), and the row of each; none crosses rows."""
    n = len(data)
    inside = within[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words`` and the hash of each; prefix sums are made for about ``CHUNK`` bytes at a time, or for a single long word."""
    starts, ends, rows = words(data, offsets)
    h, i = np.empty(len(starts), U), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + CHUNK, "right")))
        h[i:j] = spans(prefix(data[a : ends[j - 1]]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return starts, ends, rows, h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring hashes."""
    out = np.zeros(max(0, len(h) - k + 1), U)
    for i in range(k):
        out = mix(out * U(3) + h[i : len(out) + i])
    return out


def sums_of(h: np.ndarray) -> np.ndarray:
    """Prefix sums of hashes, from which ``spans`` takes the hash of any stretch of them."""
    out = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(len(h))[0][: len(h)], out=out[1:])
    return out


def joined_words(data: np.ndarray, dropped: np.ndarray) -> bytes:
    """The words of one text joined by single spaces, without the bytes marked as dropped (whole words)."""
    inside = ~SPACE[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # and the one white-space byte after a word
    gone = dropped.copy()
    gone[1:] |= dropped[:-1]
    out = np.where(inside, data, 32).astype(np.uint8)[kept & ~gone]
    return out.tobytes().rstrip(b" ")


def batches(it: Iterator[pa.RecordBatch], schema: pa.Schema, f) -> Iterator[pa.RecordBatch]:
    """f(batch) yields lists of columns; each becomes a record batch."""
    for batch in it:
        for columns in f(batch):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
