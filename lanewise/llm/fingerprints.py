"""Document fingerprints with built-in functions only: bottom-k sketches of word shingles.

A fingerprint holds the k smallest hashes of a text's distinct 5-word shingles (with fewer words, the whole sequence; without
words, none) and their number up to k.  Sketches of parts merge to the sketch of the whole: the k smallest of their union.
From two sketches come resemblance (share of the union's k smallest that both hold), containment and, from one, the number of
distinct shingles (k-th smallest hash against the hash range).

The query's *next document* is found on keys alone: distinct (doc_id, hash of the text) are dealt to ranges by Spark's range partitioning,
whatever the ids' spread, a window looks ahead within a range, and the first key of the range after it follows its last one.  Then
each document hands its sketch and as many leading characters as needed to the document before it, by two equi-joins on such keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .rules import WORD, let

SHINGLE = 5
NONE = "array<bigint>"


def sketch(text: Column, k: int) -> Column:
    """The k smallest distinct shingle hashes, ascending; a null text has none."""

    def of(words: Column) -> Column:
        n = F.size(words)
        windows = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[words[i + j] for j in range(SHINGLE)]))
        hashes = F.when(n >= SHINGLE, windows).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast(NONE))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), of)


def merged(a: Column, b: Column, k: int) -> Column:
    """Sketch of the texts of both sketches together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated Jaccard similarity, 0 to 1; 1 for two empty sketches."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    share = (F.array_max(a).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of a's shingles that b has, from the resemblance and both numbers."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def shown(a: Column) -> Column:
    """A sketch as text: hexadecimal hashes, comma-joined."""
    return F.array_join(F.transform(a, F.hex), ",")


def union_sketch(docs: DataFrame, keys: list[str], k: int = 64) -> DataFrame:
    """keys and the sketch of all texts of a group: sketches of documents, exploded, and the k smallest of the group kept.

    Distinct hashes are counted out on the map side first; a group's task gets no more than its distinct retained hashes."""
    own = docs.select(*keys, F.explode(sketch(F.col("text"), k)).alias("h")).distinct()
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy(*keys, F.pmod(F.col("h"), F.lit(64))).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("sketch"))


KEY = ["there", "id", "h"]


def keyed(docs: DataFrame) -> DataFrame:
    """text and the key of its place among all documents: null ids first, then by id, equal ids by a hash of the text."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text"), doc_id.isNotNull().alias("there"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"))


def following(docs: DataFrame) -> DataFrame:
    """For each distinct key of ``keyed`` rows: half (of the length, rounded down) and next, the key that comes after it, the first
    one after the last."""
    # the number of a range is kept by writing it: it must not be worked out anew
    keys = docs.groupBy(*KEY).agg(F.any_value(F.expr("int(length(text) div 2)")).alias("half"))
    dealt = settled(keys.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()))
    # one row for each range, as many as there are shuffle partitions
    ranges = Window.orderBy("range")
    firsts = dealt.groupBy("range").agg(F.min(F.struct(*KEY)).alias("first"))
    after = firsts.select("range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges)).alias("after"))
    ahead = F.lead(F.struct(*KEY)).over(Window.partitionBy("range").orderBy(*KEY))
    return dealt.repartitionByRange("range").withColumn("next", ahead).join(after, "range").select(*KEY, "half", F.coalesce("next", "after").alias("next"))


def with_next(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and text of each row, and of the document after it ``head``, as many leading characters as half the row's own text has,
    and ``following``, its sketch.  Rows that repeat a doc_id and a text are one document here, and get the same.

    Both joins read the same columns of the rows, so texts are shuffled once."""
    rows = keyed(docs)
    links = following(rows)
    before = links.select("half", *[F.col(c).alias(f"to_{c}") for c in KEY], *[F.col(f"next.{c}").alias(c) for c in KEY])
    to = [f"to_{c}" for c in KEY]
    given = rows.join(before, KEY).select(*to, F.expr("left(text, half)").alias("head"), sketch(F.col("text"), k).alias("following"))
    # repeated rows hand over the same
    once = given.groupBy(*to).agg(F.any_value("head").alias("head"), F.any_value("following").alias("following"))
    return rows.join(once.select(*[F.col(f"to_{c}").alias(c) for c in KEY], "head", "following"), KEY).select(F.when(F.col("there"), F.col("id")).alias("doc_id"), "text", "head", "following")


def neighbours(docs: DataFrame, k: int = 64) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, the estimated number of distinct shingles, and the estimated share of them that the
    next document holds.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's.
    A null text is an empty one.  Null ids come first; rows that share a doc_id follow each other by a hash of the text; rows that
    repeat both are one document and get the same result.  A single document is its own next one.  Long texts are hashed whole.
    """
    edited = F.concat(F.expr("left(text, int(length(text) - length(text) div 2))"), F.col("head"))
    found = with_next(docs, k).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text"), k).alias("own"), "following")
    found = found.withColumn("changed", sketch(F.col("edited"), k))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("distinct_shingles"),
        containment(F.col("own"), F.col("following"), k).alias("contained_next"),
    )
