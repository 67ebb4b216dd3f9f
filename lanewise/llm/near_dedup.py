"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, union-sketch estimate, exact Jaccard.

A document's set holds the hashes of its distinct word shingles, in lower case (A-Z); with fewer words than a shingle the
whole sequence is the one element; without words the set is empty and the document links with nothing.

1. *Sketch*: the k smallest hashes of the set under one hash function, ascending.
2. *Inverted lists*: a list for each run of r neighbouring retained values.  If J(A, B) >= 0.8, each value of the union is
   shared with chance 0.8 or more, so among the union's u smallest values there is a run of r shared ones.  For whole small
   sets this is certain: u values with at most 0.2 u gaps hold a run of ceil(0.8 u / (0.2 u + 1)), that is 4 for u > 15, 3
   for u > 5, 2 for u > 1 (at u = 1 sets are equal).  For r = 5 among 128 retained values it fails with a chance below 1e-8.
   Runs keep the lists of frequent shingles short: unrelated texts must agree on r values in a row.  No list is capped.
3. *Candidates*: copies fall into one class by the hash of the whole set before any list is built.  Each list names as its hub
   the member that stands in the most and longest lists, as the original of a group of near copies does, and proposes it with
   every other member (a star, linear in the list).
4. *Estimate*: of the k smallest values of both sets' union, the share in both; pairs 6 standard deviations below the
   threshold go.
5. *Exact*: full sets, built again from the texts, are intersected.
6. *The rest*: where the members of a hub's lists still fall into several components, all members outside its largest one are
   held against every member of another component.  They meet in tiles of about ``BLOCK`` members, fewer of long sets, and
   ``PROBES`` outsiders, so neither pairs nor a whole group are ever held by one task, and a tile writes out no more links than
   join its components.  (No sketch is asked here: pairs just below the similarity would pass it in their square number.)

Every table is keyed by hashes that spread evenly; a hot group of copies is one class, a hot group of near copies is spread
over its k runs and its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnum import LOWER, Texts, U, batches, mix, prefix, signed, spans, words
from .common import bounded_batches, settled
from .components import components

#: Runs of r retained values for sets of lo to hi elements.  Neighbouring ranges overlap by more than the factor 0.8.
RUNS = ((2, 2, 5), (3, 3, 15), (4, 4, 160), (5, 128, 1 << 60))


def shingle_sets(batch_text: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    texts = Texts(batch_text)
    for i, j, data, offsets in texts.chunks():
        low = LOWER[data]
        starts, ends, rows = words(low, offsets)
        h = spans(prefix(low), starts, ends) if len(starts) else np.zeros(0, U)
        n, bounds = len(h), np.searchsorted(rows, np.arange(j - i + 1))
        if n >= size:
            s = np.zeros(n - size + 1, U)
            for k in range(size):
                s = mix(s * U(3) + h[k : n - size + 1 + k])
        for r in range(j - i):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= size:
                yield i + r, np.unique(s[a : b - size + 1])
            elif b > a:
                x = U(b - a)
                with np.errstate(over="ignore"):
                    for v in h[a:b]:
                        x = mix(np.array([x * U(5) + v]))[0]
                yield i + r, np.array([x], U)
            else:
                yield i + r, np.zeros(0, U)


SIGNATURE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("sketch", pa.binary())])


def set_hash(s: np.ndarray) -> int:
    """A hash of the whole set."""
    return mix(s + U(77)).sum(dtype=U).view(np.int64)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def signatures(docs: DataFrame, size: int = 2, k: int = 128) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, two hashes of the whole set, and its k smallest hashes as 8-byte numbers, ascending."""

    def one(batch):
        out = [], [], [], [], []
        ids = batch.column("doc_id")
        rows = []
        for row, s in shingle_sets(batch.column("text"), size):
            rows.append(row)
            for x, v in zip(out[1:], (len(s), set_hash(s), mix(mix(s + U(77)) ^ U(99)).sum(dtype=U).view(np.int64), s[:k].tobytes()), strict=True):
                x.append(v)
        at = pa.array(rows, pa.int64())
        yield [ids.take(at), batch.column("th").take(at), *out[1:]]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: batches(it, SIGNATURE, one), "doc_id long, th long, n_shingles long, fp long, fp2 long, sketch binary")


LISTED = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def listed(classes: DataFrame) -> DataFrame:
    """A row of an inverted list for each run of retained values of each class."""

    def one(batch):
        fp, n = (batch.column(c).to_numpy() for c in ("fp", "n"))
        keys, at = [], []
        for row, raw in enumerate(batch.column("sketch").to_pylist()):
            s = np.frombuffer(raw, U)
            for r, lo, hi in RUNS:
                if lo <= n[row] <= hi and len(s) >= r:
                    x = np.full(len(s) - r + 1, r, U)
                    for i in range(r):
                        x = mix(x * U(3) + s[i : len(s) - r + 1 + i])
                    keys.append(x)
                    at.append(np.full(len(x), row))
            if len(keys) > 400:
                w = np.concatenate(at)
                yield [signed(np.concatenate(keys)), fp[w]]
                keys, at = [], []
        if keys:
            w = np.concatenate(at)
            yield [signed(np.concatenate(keys)), fp[w]]

    return classes.select("fp", "n", "sketch").mapInArrow(lambda it: batches(it, LISTED, one), "key long, fp long")


SETS = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("elements", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp and the sorted elements (8 bytes each) of each class in ``wanted`` (fp, doc), from the text with that set that the document
    has: a doc_id may stand for several texts."""

    def build(batch):
        rows, fps, elements, held = [], [], [], 0
        for row, s in shingle_sets(batch.column("text"), size):
            rows.append(row)
            fps.append(set_hash(s))
            elements.append(s.tobytes())
            held += len(elements[-1])
            if held > 1 << 22:
                yield [batch.column("doc").take(pa.array(rows, pa.int64())), fps, elements]
                rows, fps, elements, held = [], [], [], 0
        yield [batch.column("doc").take(pa.array(rows, pa.int64())), fps, elements]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    needed = texts.join(wanted.select("doc"), "doc", "left_semi").mapInArrow(lambda it: batches(it, SETS, build), "doc long, fp long, elements binary")
    # equal sets of rows that repeat a document
    return needed.groupBy("doc", "fp").agg(F.min("elements").alias("elements")).join(wanted, ["doc", "fp"]).select("fp", "elements")


def linked(p: np.ndarray, q: np.ndarray, percent: int, k: int) -> bool:
    """Union-sketch estimate, then the exact test, of two sorted sets."""
    x, y = p[:k], q[:k]
    u = np.unique(np.concatenate([x, y]))[:k]
    t = percent / 100
    both = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), u, assume_unique=True))
    if both / len(u) < t - 6 * (t * (1 - t) / len(u)) ** 0.5:
        return False
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""

    def compare(batch):
        a, b, x, y = (batch.column(c) for c in ("a", "b", "a_elements", "b_elements"))
        at = pa.array([i for i in range(len(a)) if linked(np.frombuffer(x[i].as_py(), U), np.frombuffer(y[i].as_py(), U), percent, k)], pa.int64())
        yield [a.take(at), b.take(at)]

    side = lambda s: sets.select(F.col("fp").alias(s), F.col("elements").alias(f"{s}_elements"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_elements", "b_elements").mapInArrow(lambda it: batches(it, PAIRS, compare), "a long, b long")


BLOCK, PROBES = 256, 512
#: Bytes of sets that the members of a tile have in the mean, at most: long sets make more tiles.
TILE_BYTES = 32 << 20


def across_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the members (hub, fp, n: size of the set, component) of the same hub."""
    sizes = members.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("n").alias("elements"))
    # cut, so that the join below has two plain sides and a hub with very many members can be split
    hubs = settled(
        sizes.groupBy("hub")
        .agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total"), F.sum("elements").alias("elements"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(
            "hub",
            F.col("m.component").alias("largest"),
            F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(8 * F.col("elements") / TILE_BYTES)).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("m.n")) / PROBES).cast("int")).alias("parts"),
        )
    )
    open_members = settled(members.drop("n").join(hubs, "hub"))
    # a tile is a block of members and a part of those outside the largest component
    dealt = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = F.col("i") * F.col("parts") + F.col("j")
    held = open_members.withColumn("i", dealt("blocks")).withColumn("j", every("parts")).select("hub", tile.alias("block"), F.lit(1).alias("probe"), "fp", "component")
    probes = open_members.where("component <> largest").withColumn("j", dealt("parts")).withColumn("i", every("blocks")).select("hub", tile.alias("block"), F.lit(2).alias("probe"), "fp", "component")

    def compare(it):
        at, block, index, root = None, [], None, {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        for batch in it:
            hub, place, probe, fp, comp = (batch.column(c).to_pylist() for c in ("hub", "block", "probe", "fp", "component"))
            raw = batch.column("elements")
            a, b = [], []
            for i in range(len(hub)):
                s = np.frombuffer(raw[i].as_py(), U)
                if (hub[i], place[i]) != at:
                    at, block, index, root = (hub[i], place[i]), [], None, {}
                if probe[i] == 1:
                    block.append((fp[i], comp[i], s))
                    continue
                if not block:
                    continue
                if index is None:
                    size = np.array([len(x) for _, _, x in block])
                    index = np.concatenate([x for _, _, x in block]), np.repeat(np.arange(len(block)), size), size, np.array([c for _, c, _ in block]), [f for f, _, _ in block]
                every, of, size, comps, names = index
                near = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
                shared = np.bincount(of[near], minlength=len(size))
                for j in np.flatnonzero((100 * shared >= percent * (size + len(s) - shared)) & (comps != comp[i])).tolist():
                    # a link between components that this tile has joined already says nothing new
                    p, q = top(comp[i]), top(int(comps[j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(fp[i])
                        b.append(names[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIRS)

    return held.union(probes).join(sets, "fp").select("hub", "block", "probe", "fp", "component", "elements").repartition("hub", "block").sortWithinPartitions("hub", "block", "probe").mapInArrow(compare, "a long, b long")


def linked_classes(docs: DataFrame, size: int, percent: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes of equal sets (fp, n, doc: the smallest doc_id), links (a, b) between classes, enough of them
    to join what belongs together, and what they join (node, component)."""
    if percent < 80:
        raise ValueError("runs of retained values are derived for similarities of 0.8 or more")
    docs = bounded_batches(docs)
    sig = settled(signatures(docs, size, k))
    some = sig.where("n_shingles > 0 and doc_id is not null").withColumnRenamed("n_shingles", "n")
    classes = settled(some.groupBy("fp", "n").agg(F.min("doc_id").alias("doc")))
    lists = listed(settled(some.groupBy("fp", "n").agg(F.min("sketch").alias("sketch"))))
    # lists are counted on the map side first, so one that very many classes stand in is no hot task; lists of one class end here
    shared = lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    live = settled(lists.join(shared, "key"))
    weighed = settled(live.join(live.groupBy("fp").agg(F.sum("members").alias("weight")), "fp"))
    named = weighed.groupBy("key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("hub"))
    hubs = settled(weighed.select("key", "fp").join(named, "key").select("hub", "fp").distinct())
    sets = settled(full_sets(docs, classes.select("fp", "doc").join(hubs.select("fp"), "fp", "left_semi"), size))
    links = settled(confirmed(hubs.where("hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b")), sets, percent, k))
    comp = components(links)
    sized = hubs.join(comp.withColumnRenamed("node", "fp"), "fp", "left").join(classes.groupBy("fp").agg(F.max("n").alias("n")), "fp")
    members = settled(sized.select("hub", "fp", "n", F.coalesce("component", "fp").alias("component")))
    more = settled(across_components(members, sets, percent))
    links = links.union(more)
    return sig, classes, links, components(links) if more.limit(1).count() else comp


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; further columns are ignored).

    Documents are linked if the Jaccard similarity of their full shingle sets reaches ``percent`` (80 or more: the runs are
    derived for that).  component_id is the smallest doc_id that can be reached; kept marks that document.  A null text is an
    empty one; a row without words, and one without a doc_id, forms no link and is its own component (null without a doc_id,
    and kept).  Rows that repeat a doc_id keep one result each.  If their texts differ, they are one document with several
    texts: it has the links of all of them, and what one text reaches the others reach, too.
    """
    sig, classes, links, comp = linked_classes(docs, size, percent, k)
    some = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "fp")
    several = some.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    shared = settled(some.join(several, "doc_id").where("fp <> a").select("a", "fp").distinct())
    if shared.limit(1).count():
        comp = components(links.union(shared))
    named = comp.join(classes.select(F.col("fp").alias("node"), "doc"), "node")
    smallest = named.groupBy("component").agg(F.min("doc").alias("smallest"))
    by_class = classes.select("fp", "n", "doc").join(named.join(smallest, "component").select(F.col("node").alias("fp"), "smallest"), "fp", "left")
    found = by_class.select("fp", "n", F.coalesce("smallest", "doc").alias("smallest"))
    return (
        sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
        .join(found.withColumnRenamed("n", "n_shingles"), ["fp", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 128) -> DataFrame:
    """Rows of docs, with all their columns, without near duplicates: of each group of texts that links join, the row with the smallest
    doc_id stays (if it repeats with several texts of the group, the one with the least hash).  Texts are told apart even under one
    doc_id, so no text goes whose like doesn't stay.  Rows without words or without doc_id stay; of rows equal in doc_id and text
    that would stay, one does."""
    sig, _, _, comp = linked_classes(docs, size, percent, k)
    group = comp.withColumnRenamed("node", "fp")
    some = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "th", "fp")
    first = some.join(group, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min(F.struct("doc_id", "th")).alias("m")).select("m.*")
    kept = settled(first.union(sig.where("n_shingles = 0 and doc_id is not null").select("doc_id", "th")).distinct())
    row = F.struct(*[F.col(c) for c in docs.columns])
    named = docs.where("doc_id is not null").select(row.alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_hash().alias("_th"))
    named = named.join(kept, (F.col("_doc") == F.col("doc_id")) & (F.col("_th") == F.col("th")), "left_semi")
    # partitioned by both already
    return named.groupBy("_doc", "_th").agg(F.first("_row").alias("_row")).select("_row.*").union(docs.where("doc_id is null"))
