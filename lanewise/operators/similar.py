"""Exact joins of sets of words by Jaccard similarity, without holding every pair against each other.

Words are ordered by how many sets hold them, the rarest first.  Two sets of which ``percent`` of the union is shared must share one of
the first n - ceil(percent * n / 100) + 1 words of each, and neither is much larger than the other.  So only sets that meet on
such a rare word and fit in length are compared, each pair at the first word that they share.  Equal sets are compared once.

``similar_sets`` gives every pair with both word lists; ``nearest`` looks for the best only, and moves hashes and sketches instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def _sets(rows: DataFrame, words: Column) -> DataFrame:
    """_set: the distinct sets of words, sorted, but for empty ones."""
    return rows.select(F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isNotNull()))).alias("_set")).where(F.size("_set") > 0).distinct()


def similar_sets(left: DataFrame, right: DataFrame, words_left: Column, words_right: Column, percent: int) -> DataFrame:
    """a, b (sorted arrays of distinct words), shared, total: the pairs of distinct sets of both sides with 100 * shared >= percent * total."""
    if not 0 < percent <= 100:
        raise ValueError("percent is 1 to 100")
    both = _sets(left, words_left).withColumn("_side", F.lit("a")).union(_sets(right, words_right).withColumn("_side", F.lit("b")))
    each = both.withColumn("_key", F.xxhash64("_set")).select("_side", "_key", F.explode("_set").alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("n"))
    ranked = each.join(often, "w").groupBy("_side", "_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("words"))
    n = F.size("words")
    first = F.slice("words", F.lit(1), n - F.floor((percent * n + 99) / 100).cast("int") + 1)
    probes = ranked.select("_side", "words", first.alias("first"), F.explode(first).alias("w"))
    a = probes.where("_side = 'a'").select("w", F.col("words").alias("a"), F.col("first").alias("fa"))
    b = probes.where("_side = 'b'").select("w", F.col("words").alias("b"), F.col("first").alias("fb"))
    fits = (100 * F.size("a") >= percent * F.size("b")) & (100 * F.size("b") >= percent * F.size("a"))
    met = a.join(b, "w").where(fits).where(F.col("w") == F.array_intersect("fa", "fb")[0])
    shared = F.size(F.array_intersect("a", "b"))
    pairs = met.select(F.array_sort("a").alias("a"), F.array_sort("b").alias("b"), shared.alias("shared")).withColumn("total", F.size("a") + F.size("b") - F.col("shared"))
    return pairs.where(100 * F.col("shared") >= percent * F.col("total"))


#: Buckets of the table of frequencies and of the keys that are looked for, texts that are worked on at once, parts of a group of alike sets.
BUCKETS, SOUGHT, AT_ONCE, DEALT = 1 << 20, 1 << 22, 1000, 8
#: Bits of a sketch by level; a set has the first level with 1.5 bits a word, or the last.
BITS = tuple(512 << level for level in range(8))


def _hashed(words: Column) -> Column:
    """The distinct words as sorted 64-bit hashes."""
    return F.sort_array(F.array_distinct(F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.xxhash64(w))))


def _keyed(rows: DataFrame, words: Column) -> DataFrame:
    """_set, and _key, a hash of it."""
    return rows.select(_hashed(words).alias("_set")).select("_set", F.xxhash64("_set").alias("_key"))


def _levels(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(BITS, (3 * n.astype(np.int64) + 1) // 2), len(BITS) - 1)


def _folded(sketches: list, levels: np.ndarray, level: int) -> np.ndarray:
    """Sketches of the level or the one above as rows of that level: halves of a parity sketch added up are the smaller sketch."""
    out = np.empty((len(sketches), BITS[level] // 64), np.uint64)
    for at, fold in ((np.flatnonzero(levels == level), False), (np.flatnonzero(levels == level + 1), True)):
        if len(at):
            own = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)
            out[at] = own[:, : out.shape[1]] ^ own[:, out.shape[1] :] if fold else own
    return out


def _signatures(sets: DataFrame, percent: int, often) -> DataFrame:
    """_key, n, sketch (the parity of the words in each of its level's buckets), and w and i: the words of the prefix that known sets may
    hold, and how many of the set's words come before.  Words come in order of their bucket's frequency among known sets, then of hash."""

    def run(batches):
        table = often.value
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                batch = batch.filter(pc.greater(pc.list_value_length(batch.column("_set")), 0))
                if batch.num_rows:
                    yield signed(batch, table)

    def signed(batch, table):
        lists = batch.column("_set")
        n, words = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        bits = np.array(BITS)[_levels(n)]
        ends = np.concatenate([[0], np.cumsum(bits // 64)])
        sketch = np.zeros(ends[-1], np.uint64)
        bit = (words >> 40) & (bits - 1)[row]
        np.bitwise_xor.at(sketch, ends[row] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        sketches = pa.array([sketch[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        often = table[words & (BUCKETS - 1)]
        order = np.lexsort((words, often, row))
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        first = n - (percent * n.astype(np.int64) + 99) // 100 + 1
        kept = (place < first[row]) & (often[order] > 0)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))]), pa.int32())
        w, i = pa.array(words[order][kept], pa.int64()), pa.array(place[kept], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int32()), sketches, pa.ListArray.from_arrays(ends, w), pa.ListArray.from_arrays(ends, i)], names=["_key", "n", "sketch", "w", "i"])

    return sets.select("_key", "_set").mapInArrow(run, "_key long, n int, sketch binary, w array<long>, i array<int>")


def _unlike_dropped(lists: DataFrame, percent: int, known) -> DataFrame:
    """a and bs: what is left of the known sets met by each, where sketches don't show too many different words; an equal set alone."""

    def run(batches):
        keys, sizes, held = known.value
        levels, at_level = _levels(sizes), {}
        place = np.zeros((len(BITS), len(keys)), np.int64)
        for level in range(len(BITS)):
            has = np.flatnonzero((levels == level) | (levels == level + 1))
            place[level, has] = np.arange(len(has))
            at_level[level] = _folded([held[i].as_py() for i in has], levels[has], level)
        for batch in batches:
            met = batch.column("bs")
            each = np.repeat(np.arange(batch.num_rows), met.value_lengths().to_numpy())
            b = met.flatten().to_numpy()
            a, n = batch.column("a").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            own, mine = batch.column("sketch").to_pylist(), _levels(n)
            i = np.searchsorted(keys, b)
            both = n[each] + sizes[i]
            most = both - 2 * -(-percent * both // (100 + percent))
            lower = np.minimum(mine[each], levels[i])
            # sizes are too unlike for more than one level between them where percent is above 50; such pairs stay
            kept = np.abs(mine[each] - levels[i]) > 1
            for level in np.unique(lower[~kept]):
                rows = np.flatnonzero((mine == level) | (mine == level + 1))
                there = np.zeros(batch.num_rows, np.int64)
                there[rows] = np.arange(len(rows))
                a_sketch = _folded([own[x] for x in rows], mine[rows], level)
                pairs = np.flatnonzero((lower == level) & ~kept)
                step = (1 << 25) // BITS[level]
                for at in range(0, len(pairs), step):
                    p = pairs[at : at + step]
                    kept[p] = np.bitwise_count(a_sketch[there[each[p]]] ^ at_level[level][place[level, i[p]]]).sum(axis=1, dtype=np.int64) <= most[p]
            same = a[each] == b
            has = np.zeros(batch.num_rows, bool)
            has[each[same]] = True
            kept &= same | ~has[each]
            left = np.bincount(each[kept], minlength=batch.num_rows)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), pa.array(b[kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), out], names=["a", "bs"]).filter(pa.array(left > 0))

    return lists.select("a", "n", "sketch", "bs").mapInArrow(run, "a long, bs array<long>")


def _sought(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """a and sa: the sets whose key may be among those of ``lists``, by a table of fixed size."""
    table = np.zeros(SOUGHT, bool)
    table[lists.select(F.col("a").bitwiseAND(SOUGHT - 1).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    held = sets.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches):
        table = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(table[batch.column("a").to_numpy() & (SOUGHT - 1)]))

    return sets.select(F.col("_key").alias("a"), F.col("_set").alias("sa")).mapInArrow(run, "a long, sa array<long>")


def _scored(rows: DataFrame, named: DataFrame, words: Column, percent: int) -> DataFrame:
    """a, b, shared, total: keys of similar sets of rows and ``named`` (_set, _key), but for sets that have an equal one: those with that alone."""
    sc = rows.sparkSession.sparkContext
    counts = named.select(F.explode("_set").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).alias("at")).count().toArrow()
    table = np.zeros(BUCKETS, np.int32)
    table[counts.column("at").to_numpy()] = counts.column("count").to_numpy()
    often = sc.broadcast(table)
    sets = _keyed(rows, words)
    left, right = cut(_signatures(sets, percent, often)), cut(_signatures(named, percent, often))
    held = right.select("_key", "n", "sketch").toArrow().sort_by("_key")
    known = sc.broadcast((held.column("_key").to_numpy(), held.column("n").to_numpy().astype(np.int64), held.column("sketch").combine_chunks()))

    def probes(signed, key):
        each = signed.select(F.col("_key").alias(key), F.col("n").alias(f"n{key}"), F.explode(F.arrays_zip("w", "i")).alias("p"))
        return each.select(F.col("p.w").alias("w"), key, f"n{key}", F.col("p.i").alias(f"i{key}"))

    # at the first word that two similar sets share, what is left of both is enough; equal sets go on as one
    enough = (100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= percent * (F.col("na") + F.col("nb"))
    met = probes(left, "a").repartition("w").dropDuplicates(["w", "a"]).join(probes(right, "b"), "w").where(enough)
    lists = met.groupBy("a").agg(F.collect_set("b").alias("bs"))
    lists = lists.join(left.select(F.col("_key").alias("a"), "n", "sketch").dropDuplicates(["a"]), "a")
    lists = cut(_unlike_dropped(lists, percent, known)).withColumn("g", F.array_min("bs")).withColumn("_part", F.pmod("a", F.lit(DEALT)))
    # sets that share their least known set meet it and the others once, not once a pair
    there = lists.select("g", "_part", F.explode("bs").alias("b")).distinct().join(named.select(F.col("_key").alias("b"), F.col("_set").alias("sb")), "b")
    here = _sought(sets, lists).join(lists, "a").dropDuplicates(["a"])
    pairs = here.join(there, ["g", "_part"]).where(F.array_contains("bs", F.col("b")))
    shared = pairs.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
    return shared.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("total")).where(100 * F.col("shared") >= percent * F.col("total"))


def nearest(rows: DataFrame, known: DataFrame, words: Column, known_words: Column, value: str, percent: int) -> DataFrame:
    """rows with ``nearest`` (the known value whose words are most similar, the smallest on ties) and ``similarity``; null where none
    reaches ``percent``, as for rows without words.

    Values with equal words count as one, the smallest.  Words and sets are told apart by 64-bit hashes.  No pair carries words: sets meet
    by their rarest words, sketches drop the unlike, and words go only with what is left.  The driver holds
    a sketch and 16 bytes for each distinct known set, each task twice that."""
    if not 0 < percent <= 100:
        raise ValueError("percent is 1 to 100")
    named = known.select(_hashed(known_words).alias("_set"), F.col(value).alias("_value")).groupBy("_set").agg(F.min("_value").alias("_value")).where(F.size("_set") > 0)
    named = cut(named.select("_set", "_value", F.xxhash64("_set").alias("_key")))
    scored = _scored(rows, named, words, percent).select("a", "b", (F.col("shared") / F.col("total")).alias("s"))
    best = scored.groupBy("a").agg(F.max("s").alias("similarity"), F.collect_list(F.struct("s", "b")).alias("all"))
    tied = best.select("a", "similarity", F.explode(F.filter("all", lambda x: x["s"] == F.col("similarity"))).alias("x")).select("a", "similarity", F.col("x.b").alias("b"))
    best = tied.join(named.select(F.col("_key").alias("b"), "_value"), "b").groupBy("a").agg(F.min("_value").alias("nearest"), F.first("similarity").alias("similarity"))
    keyed = rows.withColumn("_a", F.xxhash64(_hashed(words)))
    return keyed.join(best, F.col("_a") == F.col("a"), "left").drop("_a", "a")
