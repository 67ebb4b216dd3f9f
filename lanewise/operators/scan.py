"""Running sums and extremes over rows in a total order, without a window over a whole group.

Rows are dealt to ranges of that order, of about equal size whatever the groups' sizes are.  A range's part of a group is summed up,
the few sums are added up along the ranges, and each range goes on from what stood before it.  A group that holds all rows is as
many tasks as there are ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

RANGE = "_range"


def ranged(rows: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """rows with ``_range``: numbers that ascend with (by, order).  Written once, as the ranges come from a sample of the rows.

    ``order`` has to be total within a group.  Without a folder for checkpoints nothing can be written, and there is one range."""
    spark = rows.sparkSession
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        return rows.withColumn(RANGE, F.lit(0))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *by, *order).withColumn(RANGE, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right for the same range and group; a null is a group, too."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in [*by, RANGE]})
    condition = F.col(RANGE) == F.col(f"_r_{RANGE}")
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, condition, "left").drop(*[f"_r_{c}" for c in [*by, RANGE]])


def running_sums(parts: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """parts (of ``ranged``) with the sum of each expression over the rows of the group up to this one."""
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.groupBy(*by, RANGE).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    base = own.select(*by, RANGE, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    here = Window.partitionBy(*by, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _same(parts, base, by)
    return out.withColumns({n: F.sum(c).over(here) + F.col(f"_{n}") for n, c in sums.items()}).drop(*[f"_{n}" for n in sums])


def running_maximum_from_end(parts: DataFrame, by: list[str], back: list[Column], value: str, name: str) -> DataFrame:
    """parts with the maximum of ``value`` over the rows of the group from this one on; ``back`` is the order turned round."""
    after = Window.partitionBy(*by).orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    most = parts.groupBy(*by, RANGE).agg(F.max(value).alias("_most")).select(*by, RANGE, F.max("_most").over(after).alias("_later"))
    here = Window.partitionBy(*by, RANGE).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    return _same(parts, most, by).withColumn(name, F.greatest(F.max(value).over(here), F.col("_later"))).drop("_later")


def _starts(keys: list[pa.Array], last: list[pa.Array] | None) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; ``last`` has the row before the first, if there is one."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = last is None
    for i, k in enumerate(keys):
        k = pa.concat_arrays([k[:1] if last is None else last[i], k])
        a, b = k[1:], k[:-1]
        new |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return new


def counted(rows: DataFrame, marks: DataFrame, by: list[str], order: dict[str, bool], flags: int, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """marks with n and sums, and the groups of rows.  ``order``: columns, and whether they descend.

    A mark is one of the rows, the ``nth`` (from 1) of those of its group that are equal in ``order``, with ``levels``, a number above 0
    whose lowest bits are its flags.  n: how many rows of its group there are up to it; sums: for each flag, how many marks up to it have it.
    Rows pass one shuffle, by ranges of the order and with nothing else; only marks and the totals of ranges are written.  Without a
    folder for checkpoints a group is one range."""
    spark = rows.sparkSession
    along = [*by, *[F.col(c).desc() if down else F.col(c) for c, down in order.items()]]
    zero = F.lit(0).cast("long")
    both = rows.select(*by, *order, zero.alias("levels"), zero.alias("nth")).union(marks.select(*by, *order, F.col("levels").cast("long"), F.col("nth").cast("long")))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        parts, number = both.repartitionByRange(n, *along), F.spark_partition_id()
    else:
        parts, number = both.repartition(n, *by), F.lit(0)
    # marks stand before the rows that are equal to them in order
    parts = parts.sortWithinPartitions(*along, F.col("nth") == 0, "nth").select(*by, number.alias(RANGE), "levels", "nth")
    width = len(by)

    def walk(batches):
        last, n, sums = None, 0, np.zeros(flags, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.columns[:width]
            levels, nth = (batch.column(c).to_numpy() for c in ("levels", "nth"))
            new = _starts(keys, last)
            first = np.flatnonzero(new)
            group = np.cumsum(new)  # 0: the group that the batch before has begun
            at = np.flatnonzero(levels)
            bits = levels[at, None] >> np.arange(flags) & 1
            # before each row, in the batch: rows and flags; the same at the start of its group; what the group has from the batches before
            seen = np.concatenate([[0], np.cumsum(nth == 0)])
            set_ = np.concatenate([np.zeros((1, flags), np.int64), np.cumsum(bits, axis=0)])
            begin = np.concatenate([[0], first])
            begin_mark = np.searchsorted(at, begin)
            had = np.zeros(len(begin), np.int64)
            had_set = np.zeros((len(begin), flags), np.int64)
            had[0], had_set[0] = n, sums
            g = group[at]
            yield out(batch.take(pa.array(at)), levels[at], had[g] + seen[at] - seen[begin[g]] + nth[at], had_set[g] + set_[1:] - set_[begin_mark[g]])
            end, end_mark = np.append(begin[1:], len(levels)), np.append(begin_mark[1:], len(at))
            n_, sums_ = had + seen[end] - seen[begin], had_set + set_[end_mark] - set_[begin_mark]
            if last is not None and len(begin) > 1:
                yield out(whole, [0], n_[:1], sums_[:1])
            if len(begin) > 2:
                yield out(batch.take(pa.array(begin[1:-1])), np.zeros(len(begin) - 2, np.int64), n_[1:-1], sums_[1:-1])
            n, sums, whole = n_[-1], sums_[-1], batch.slice(len(levels) - 1)
            last = whole.columns[:width]
        if last is not None:
            yield out(whole, [0], [n], sums[None])

    def out(batch, levels, n, sums):
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * flags, pa.int32()), pa.array(np.ravel(sums), pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(levels, pa.int64()), pa.array(n, pa.int64()), sums], names=[*by, RANGE, "levels", "n", "sums"])

    kinds = dict(both.dtypes)
    found = cut(parts.mapInArrow(walk, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"{RANGE} int, levels long, n long, sums array<long>"])))
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    base = found.where("levels = 0").select(
        *by, RANGE, F.coalesce(F.sum("n").over(before), zero).alias("_n"), F.array(*[F.coalesce(F.sum(F.col("sums")[k]).over(before), zero) for k in range(flags)]).alias("_sums")
    )
    each = _same(found.where("levels <> 0"), base, by)
    each = each.select(*by, "levels", (F.col("n") + F.col("_n")).alias("n"), F.zip_with("sums", "_sums", lambda a, b: a + b).alias("sums"))
    return each, base.select(*by).distinct()


def batched(rows: DataFrame, order: list[str], size: int, within: list[str], ranges: int | None = None) -> DataFrame:
    """rows with ``batch``: the 0-based batch of ``size`` rows within a group, in order."""
    columns = [F.col(c) for c in order]
    numbered = running_sums(ranged(rows, within, columns, ranges), within, columns, {"_n": F.lit(1)})
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n", RANGE)
