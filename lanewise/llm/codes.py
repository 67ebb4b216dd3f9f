"""Compression of vectors to codes: product quantisation with integer codebooks that are refined in rounds.

Vectors become integers, ``floor(scale * x)``, and are cut into equal parts.  Each part has a codebook of up to ``entries``
integer entries, which starts as that part of the first vectors.  A round assigns every part to its nearest entry and replaces
each entry by the mean of its parts, rounded down.

*Assignment* runs in Arrow batches: |x|^2 - 2 x c + |c|^2 for all entries at once, as an exact int64 matrix product; the first
least distance wins.  *Update*: a task adds up its parts by entry, at most parts * entries rows however many vectors it reads;
a shuffle grouped by (part, entry) merges them.  The codebooks are the only thing that passes through the driver and is
broadcast: entries * width numbers, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import settled

#: Vectors whose distances are worked out at a time.
BLOCK = 2048


def usable(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """vec_id, v, label of the vectors that have components, none of them null or not finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).alias("vec_id"), v.alias("v"), F.col(label).alias("label")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def integers(column: pa.ListArray, width: int, scale: int, parts: int) -> np.ndarray:
    """The vectors as rows of integers.  Raises where a component is so large that squared distances could pass 64 bits."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * float(scale))
    # a vector's error is at most width * (2 m)^2, and m is also the bound of every mean
    if x.size and np.abs(x).max() >= np.sqrt(2.0**60 / width):
        raise OverflowError(f"a component beyond {np.sqrt(2.0**60 / width) / scale:g} has no exact 64-bit distances")
    return x.astype(np.int64)


def assigned(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For blocks of rows: the nearest entry of each part, and the squared distances."""
    parts, _, m = books.shape
    norms = (books * books).sum(2)
    for i in range(0, len(x), BLOCK):
        s = slice(i, min(i + BLOCK, len(x)))
        entry, far = np.empty((s.stop - i, parts), np.int64), np.empty((s.stop - i, parts), np.int64)
        for p in range(parts):
            part = x[s, p * m : (p + 1) * m]
            d = norms[p] - 2 * (part @ books[p].T)
            entry[:, p] = d.argmin(1)
            far[:, p] = d[np.arange(len(d)), entry[:, p]] + (part * part).sum(1)
        yield s, entry, far


def refined(good: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round over the vectors ``good``."""
    parts, entries, m = books.shape
    shared = good.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add_up(it):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, m), np.int64)
        for batch in it:
            x = integers(batch.column("v"), parts * m, scale, parts)
            for s, entry, _ in assigned(x, shared.value):
                for p in range(parts):
                    np.add.at(sums[p], entry[:, p], x[s, p * m : (p + 1) * m])
                    n[p] += np.bincount(entry[:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], schema=schema)

    added = good.select("v").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    merged = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(m)]).alias("sums")).collect()
    new = books.copy()
    for row in merged:
        new[row.part, row.entry] = np.array(row["sums"], np.int64) // row.n
    shared.unpersist()
    return new


def compressed(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, scale: int = 1024, rounds: int = 4
) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256 for each usable vector.

    Left out: null and empty vectors, those with null or non-finite components, and those whose length isn't that of the
    vector with the smallest vec_id.  Codebooks start from the ``entries`` smallest vec_ids, rows of equal ids in the order of
    their vectors, null ids last; with fewer vectors they are smaller.  Repeated rows count as often as they stand there.
    ``label_error`` sums the errors of equal labels, nulls together.  An empty table gives an empty result.  A length that
    ``parts`` doesn't divide is a ValueError, a component too large for exact distances (beyond 131,072 at width 64) an
    OverflowError.  ``entries`` may be 256 at most, as codes have two digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    good = usable(vectors, id_column, vector, label)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    kinds = {f.name: f.dataType for f in good.schema.fields}
    schema = StructType([StructField("vec_id", kinds["vec_id"]), StructField("label", kinds["label"]), StructField("code", StringType()), StructField("error", LongType())])
    first = good.orderBy(*order).select(F.size("v").alias("width")).head()
    if first is None:
        return good.sparkSession.createDataFrame([], schema).select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = first.width
    if width % parts:
        raise ValueError(f"vectors of length {width} can't be cut into {parts} equal parts")
    good = good.where(F.size("v") == width)
    start = integers(pa.array([row.v for row in good.orderBy(*order).limit(entries).select("v").collect()], pa.list_(pa.float64())), width, scale, parts)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(good, books, scale)
    shared = good.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def encode(it):
        for batch in it:
            x = integers(batch.column("v"), width, scale, parts)
            code, error = [], np.zeros(len(x), np.int64)
            for s, entry, far in assigned(x, shared.value):
                code += ["".join(row) for row in digits[entry]]
                error[s] = far.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], names=schema.names)

    coded = settled(good.select("vec_id", "label", "v").mapInArrow(encode, schema))
    # cut: two plain sides, of which Spark broadcasts the smaller one by its size, or splits the skewed one
    sums = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(*schema.names, "label_error", F.lit(digest).alias("codebooks_sha256"))
