"""Evaluation of detected boxes: matching, average precision, top-k hits, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.text import let
from ..sources.tables import cut
from . import scan

BOX = ("x1", "y1", "x2", "y2")
#: Parts that the boxes of a key are dealt to.
PARTS = 32
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def overlaps(truth: DataFrame, found: DataFrame, image: str = "image") -> DataFrame:
    """Boxes of the same image with their overlap: truth_id, found_id, score, iou."""
    t = truth.select(image, F.col("box_id").alias("truth_id"), *[F.col(c).alias(f"t_{c}") for c in BOX])
    d = found.select(image, F.col("box_id").alias("found_id"), "score", *BOX)
    return t.join(d, image).withColumn("iou", iou([F.col(c) for c in BOX], [F.col(f"t_{c}") for c in BOX])).select(image, "truth_id", "found_id", "score", "iou")


def hits(truth: DataFrame, found: DataFrame, threshold: float, image: str = "image") -> DataFrame:
    """found with hit: some truth of the image overlaps by the threshold or more.  Several boxes may hit one truth.

    Box ids need to be unique within their image only."""
    best = overlaps(truth, found, image).groupBy(image, "found_id").agg(F.max("iou").alias("_iou"))
    return found.join(best.withColumnRenamed("found_id", "box_id"), [image, "box_id"], "left").withColumn("hit", F.coalesce(F.round("_iou", 9) >= threshold, F.lit(False))).drop("_iou")


def top_k_rate(scored: DataFrame, ks: list[int], image: str, order: list[Column]) -> DataFrame:
    """k, images, rate: share of images with a hit among the k boxes that come first."""
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy(image).orderBy(*order)))
    first = ranked.groupBy(image).agg(F.min(F.when(F.col("hit"), F.col("_r"))).alias("first"))
    per_k = first.select("first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return per_k.groupBy("k").agg(F.count("*").alias("images"), F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("rate"))


def greedy(truth: DataFrame, found: DataFrame, thresholds: list[float], image: str = "image", most: int | None = None) -> DataFrame:
    """threshold, found_id, score, matched: in order of score, each box takes the free truth of the highest overlap.

    ``most``: only so many boxes of an image, those of the highest score, take part, as some users of this metric want it; None
    for all.  Pairs are collected by image and folded over in the JVM."""
    kept = found
    if most is not None:
        kept = found.withColumn("_r", F.row_number().over(Window.partitionBy(image).orderBy(F.col("score").desc(), "box_id"))).where(F.col("_r") <= most).drop("_r")
    ids = dict(truth.dtypes)["box_id"]
    near = overlaps(truth, kept, image).withColumn("iou", F.round("iou", 9)).where(F.col("iou") >= min(thresholds))
    # a box that overlaps no truth enough at any threshold needs no walk
    pairs = near.groupBy(image, "found_id", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("less"), F.col("truth_id").alias("t")))).alias("options"))
    lists = pairs.groupBy(image).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "found_id", "options"))).alias("boxes"))
    each = lists.select(image, "boxes", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    start = F.struct(F.array().cast(f"array<{ids}>").alias("taken"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, box: Column) -> Column:
        free = F.filter(box["options"], lambda o: (-o["less"] >= F.col("threshold")) & ~F.array_contains(acc["taken"], o["t"]))
        return let(free, lambda f: F.struct(F.concat(acc["taken"], F.transform(F.slice(f, 1, 1), lambda o: o["t"])).alias("taken"), F.array_append(acc["out"], F.size(f) > 0).alias("out")))

    done = each.withColumn("m", F.aggregate("boxes", start, step)["out"])
    walked = done.select(image, "threshold", F.explode(F.arrays_zip("boxes", "m")).alias("z")).select(image, "threshold", F.col("z.boxes.found_id").alias("found_id"), (-F.col("z.boxes.less")).alias("score"), F.col("z.m").alias("matched"))
    others = kept.withColumnRenamed("box_id", "found_id").join(pairs, [image, "found_id"], "left_anti").select(image, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), "found_id", "score", F.lit(False).alias("matched"))
    return walked.union(others)


def greedy_levels(boxes: DataFrame, thresholds: list[float], image: str = "image") -> DataFrame:
    """What ``greedy`` matches, as one row for each found box that takes a truth at some threshold: image, found_id, score, levels (bit k is
    set if it does so at thresholds[k]), and nth, its place by box_id among the image's found boxes of the same score.

    ``boxes`` has truths and found boxes, told apart by ``truth``, so that one shuffle by image brings them together."""
    ids = dict(boxes.dtypes)["box_id"]
    truths = F.collect_list(F.when(F.col("truth"), F.struct("box_id", *BOX))).over(Window.partitionBy(image))
    kept = boxes.where(F.col(image).isNotNull()).withColumn("_t", truths).where(~F.col("truth") & (F.size("_t") > 0))
    placed = kept.withColumn("nth", F.row_number().over(Window.partitionBy(image, "score").orderBy("box_id")))
    pairs = placed.select(image, F.col("box_id").alias("found_id"), "score", "nth", *BOX, F.explode("_t").alias("t"))
    over = pairs.withColumn("iou", F.round(iou([F.col(c) for c in BOX], [F.col(f"t.{c}") for c in BOX]), 9)).where(F.col("iou") >= min(thresholds))
    near = over.groupBy(image, "found_id", "score", "nth").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("less"), F.col("t.box_id").alias("t")))).alias("options"))
    # without a score last, NaN first, as in a descending order
    place = F.struct(F.col("score").isNull().alias("none"), (~F.isnan("score")).alias("number"), (-F.col("score")).alias("less"), "found_id", "score", "nth", "options")
    lists = near.groupBy(image).agg(F.array_sort(F.collect_list(place)).alias("boxes"))
    start = F.struct(F.array().cast(f"array<{ids}>").alias("taken"), F.array().cast("array<boolean>").alias("out"))

    def at(threshold: Column) -> Column:
        def step(acc: Column, box: Column) -> Column:
            free = F.filter(box["options"], lambda o: (-o["less"] >= threshold) & ~F.array_contains(acc["taken"], o["t"]))
            return let(free, lambda f: F.struct(F.concat(acc["taken"], F.transform(F.slice(f, 1, 1), lambda o: o["t"])).alias("taken"), F.array_append(acc["out"], F.size(f) > 0).alias("out")))

        return F.aggregate("boxes", start, step)["out"]

    walked = lists.select(image, "boxes", F.transform(F.array(*map(F.lit, thresholds)), at).alias("m")).select(image, "m", F.posexplode("boxes").alias("i", "b"))
    levels = sum((F.when(F.get(F.col("m")[k], F.col("i")), 1 << k).otherwise(0).cast("long") for k in range(len(thresholds))), F.lit(0).cast("long"))
    return walked.select(image, "b.found_id", "b.score", levels.alias("levels"), "b.nth").where("levels > 0")


def average_precision_at(found: DataFrame, matched: DataFrame, positives: DataFrame, by: list[str], thresholds: list[float], image: str = "image", ranges: int | None = None) -> DataFrame:
    """by, threshold, ap, in order of score and image, for the keys of ``positives`` (by, positives) that have found boxes.

    ``matched`` is of ``greedy_levels``, with the keys.  Between two matched boxes precision only falls, so an unmatched one counts, once
    for all thresholds, but has no row of its own."""
    each, keys = scan.counted(found, cut(matched), by, {"score": True, image: False}, len(thresholds), ranges)
    level = lambda k, x: F.struct(F.lit(x).alias("threshold"), F.when(F.col("levels").bitwiseAND(1 << k) > 0, F.col("sums")[k]).alias("tp"))
    rows = each.join(positives, by).select(*by, "positives", "n", F.inline(F.array(*[level(k, x) for k, x in enumerate(thresholds)]))).where("tp is not null")
    curve = rows.select(*by, "threshold", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")), F.lit(0.0)).alias("recall"), (F.col("tp") / F.col("n")).alias("envelope"))
    every = keys.join(positives, by).select(*by, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return every.join(average_precision(curve, [*by, "threshold"]), [*by, "threshold"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def precision_recall(scored: DataFrame, positives: int | Column, by: list[str], hit: str, order: list[Column], ranges: int | None = None) -> DataFrame:
    """Running tp, fp, precision, recall, and the envelope: the best precision from here on.

    ``order`` is total within a key.  Rows are scanned by ranges of it, so a key that holds all boxes is spread over as many tasks."""
    goal = F.lit(positives) if isinstance(positives, int) else positives
    parts = scan.ranged(scored, by, order, ranges)
    out = scan.running_sums(parts, by, order, {"tp": F.col(hit).cast("long"), "fp": (~F.col(hit)).cast("long"), "_all": F.lit(1)})
    out = out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), goal.cast("double")), F.lit(0.0))})
    return scan.running_maximum_from_end(out, by, [F.col("_all").desc()], "precision", "envelope").drop("_all", scan.RANGE)


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the envelope at 101 recalls; a curve's rows are reduced to one for each step of recall first."""
    steps = curve.withColumn("step", F.floor(F.round(F.col("recall") * 100, 9)).cast("int")).groupBy(*by, "step").agg(F.max("envelope").alias("p"))
    marks = steps.groupBy(*by).agg(F.collect_list(F.struct("step", "p")).alias("s"))
    at = lambda r: F.coalesce(F.array_max(F.transform(F.filter("s", lambda x: x["step"] >= r), lambda x: x["p"])), F.lit(0.0))
    return marks.select(*by, (F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), at), F.lit(0.0), lambda a, v: a + v) / 101).alias("ap"))


def suppressed(found: DataFrame, image: str, limit: float = 0.5) -> DataFrame:
    """Greedy suppression: in order of score a box stays unless one that stays overlaps it by more than the limit.

    Boxes of an image are folded over as a sorted array in the JVM; images are independent."""
    box = F.struct((-F.col("score")).alias("less"), F.col("box_id"), *BOX)
    lists = found.groupBy(image).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.filter("boxes", lambda b: F.lit(False))

    def step(kept: Column, b: Column) -> Column:
        covered = F.exists(kept, lambda k: F.round(iou([b[c] for c in BOX], [k[c] for c in BOX]), 9) > limit)
        return F.when(covered, kept).otherwise(F.array_append(kept, b))

    return lists.select(image, F.explode(F.aggregate("boxes", none, step)).alias("b")).select(image, "b.box_id", (-F.col("b.less")).alias("score"), *[f"b.{c}" for c in BOX])


def confident(found: DataFrame, image: str, limit: float) -> DataFrame:
    """Boxes with a score above the limit, or the least score of the image if that is higher."""
    least = F.min("score").over(Window.partitionBy(image))
    return found.withColumn("_least", least).where(F.col("score") >= F.greatest(F.lit(limit), F.col("_least"))).drop("_least")


def similarity(boxes: DataFrame, prompts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Dot product of each box's vector with each prompt's of the same keys.

    The boxes of a key are dealt to ``PARTS`` parts by a hash of their vector, and the prompts, the stated query set and fewer by
    nature, are given to each part: a key that holds a third of all rows is as many groups."""
    from ..functions.geometry import dot

    dealt = boxes.withColumn("_part", F.pmod(F.xxhash64(a), F.lit(PARTS)).cast("int"))
    given = prompts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(given, [*keys, "_part"]).withColumn("similarity", dot(F.col(a), F.col(b))).drop("_part")
