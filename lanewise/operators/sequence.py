"""Operators on ordered frames of a scene.  All take the scene's key first, so a scene is one window partition and scenes spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import FRAME_SECONDS


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_frame_index(frames: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """0-based position of each frame."""
    return frames.withColumn(name, F.row_number().over(ordered(keys, order)) - 1)


def backward(before: Column, value: Column, seconds: float = FRAME_SECONDS) -> Column:
    """Change since the value before, by the fixed frame time; 0 where there is none."""
    return F.coalesce((value - before) / seconds, F.lit(0.0))


def central(before: Column, value: Column, after: Column, seconds: float = FRAME_SECONDS) -> Column:
    """Central difference of neighbouring values; one-sided where one is missing, null where both are."""
    return F.when(before.isNull(), (after - value) / seconds).when(after.isNull(), (value - before) / seconds).otherwise((after - before) / (2 * seconds))


def range_rate(distance: Column, w: WindowSpec, seconds: float = FRAME_SECONDS) -> Column:
    """Change of a distance by the fixed frame time; 0 for the first frame."""
    return backward(F.lag(distance).over(w), distance, seconds)


def gradient(value: Column, w: WindowSpec, seconds: float = FRAME_SECONDS) -> Column:
    """Central difference; one-sided at both ends; null for a single frame."""
    return central(F.lag(value).over(w), value, F.lead(value).over(w), seconds)


def cumulative(condition: Column, w: WindowSpec) -> Column:
    """How many frames up to here met the condition (not in a row)."""
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def between(value: Column, v0: Column, t0: Column, v1: Column, t1: Column, time: Column) -> Column:
    """The value, else the straight line from (t0, v0) to (t1, v1) at ``time``; the one that is there if the other isn't."""
    return F.when(value.isNotNull(), value).when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(v0 + (v1 - v0) * (time - t0) / (t1 - t0))


def around(keys: list[str], order: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """All rows up to this one, in ascending and in descending order: a frame that grows from the start is one pass, one that reaches
    to the end would be worked out anew for every row."""
    back = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return back, Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)


def interpolated(value: Column, time: Column, keys: list[str], order: list[str]) -> Column:
    """Linear interpolation of missing values between the nearest observed frames; the outer ones hold at the ends."""
    at = F.when(value.isNotNull(), F.struct(value.alias("v"), time.alias("t")))
    v0, v1 = (F.last(at, ignorenulls=True).over(w) for w in around(keys, order))
    return between(value, v0["v"], v0["t"], v1["v"], v1["t"], time)


def ego_motion(frames: DataFrame, keys: list[str], order: list[str], position: tuple[str, str, str]) -> DataFrame:
    """Adds ego_speed and the unit direction ux, uy, uz since the frame before; zeros for the first frame and for none."""
    w = ordered(keys, order)
    d = [F.coalesce(F.col(p) - F.lag(p).over(w), F.lit(0.0)) for p in position]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    moved = frames.withColumn("_length", length)
    unit = {n: F.when(F.col("_length") > 1e-6, x / F.col("_length")).otherwise(0.0) for n, x in zip(("ux", "uy", "uz"), d, strict=True)}
    return moved.withColumns({"ego_speed": F.col("_length") / FRAME_SECONDS} | unit).drop("_length")


def best_frame(rows: DataFrame, keys: list[str], score: Column, ties: list[str]) -> DataFrame:
    """The row of each key with the highest score, the earliest by ``ties``.  Aggregates before it shuffles."""
    order = F.struct(score.alias("score"), *[(-F.col(t)).alias(t) for t in ties])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("best"))
    return best.select("best.*")


def previous_pairs(frames: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Each frame with the index of the one before; the first frame is paired as the second with the first."""
    most = F.max(idx).over(Window.partitionBy(*keys))
    current = F.when(F.col(idx) == 0, F.least(F.lit(1), most)).otherwise(F.col(idx))
    return frames.withColumn("current_idx", current).withColumn("previous_idx", F.greatest(F.col("current_idx") - 1, F.lit(0)))


def suffix_minimum(points: DataFrame, path: DataFrame, keys: list[str], at: tuple[str, ...], along: tuple[str, ...], name: str = "min_distance", needed: Column | None = None, block: int = 1024) -> DataFrame:
    """points with the least distance from ``at`` to the path's positions ``along`` at the same frame or later; null where there is none,
    or where ``needed`` doesn't hold.

    keys: the scene, what else names a point, and the frame's index last; the path has the scene and the index.

    The path is cut into blocks of frames with bounding boxes.  A point looks at the boxes of its own block and the later ones: the last
    position of a box is a distance that counts if it isn't before the point's frame, and a box that is no nearer than the least of
    these can't do better.  Only frames of the blocks that are left are measured.  Both joins are by (scene, block), so no task holds
    a scene, and a point costs a box for each later block and a few blocks of frames instead of all later frames.  (A path that stays
    in one place and trembles leaves all its blocks open.)"""
    scene, idx = keys[0], keys[-1]
    axes = range(len(along))
    in_block = lambda i: F.floor(F.col(i) / block).cast("long")
    p = path.select(F.col(scene).alias("_s"), F.col(idx).alias("_i"), *[F.col(c).alias(f"_p{k}") for k, c in enumerate(along)], in_block(idx).alias("_block"))
    for k in axes:
        p = p.where(F.col(f"_p{k}").isNotNull())
    sides = [f(f"_p{k}").alias(f"{side}{k}") for k in axes for side, f in (("lo", F.min), ("hi", F.max))]
    boxes = p.groupBy("_s", "_block").agg(F.max("_i").alias("last"), F.max_by(F.struct(*[F.col(f"_p{k}").alias(f"at{k}") for k in axes]), "_i").alias("_e"), *sides)
    boxes = boxes.select("_s", F.struct("_block", "last", "_e.*", *[f"{side}{k}" for k in axes for side in ("lo", "hi")]).alias("_box"), "_block")
    # a row for each block of a scene; one without positions has the boxes of the next one
    w = Window.partitionBy("_s").orderBy(F.col("_block").desc())
    views = boxes.select("_s", F.collect_list("_box").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_boxes"), (F.lead("_block", 1, -1).over(w) + 1).alias("_from"), "_block")
    views = views.select("_s", "_boxes", F.explode(F.sequence("_from", "_block")).alias("_own"))

    square = lambda parts: sum((g * g for g in parts[1:]), parts[0] * parts[0])
    end = lambda c: square([F.col(x) - c[f"at{k}"] for k, x in enumerate(at)])
    off = lambda c: square([F.greatest(c[f"lo{k}"] - F.col(x), F.lit(0.0), F.col(x) - c[f"hi{k}"]) for k, x in enumerate(at)])
    seen = F.transform("_boxes", lambda c: F.when(c["last"] >= F.col(idx), F.struct(end(c).alias("end"), off(c).alias("off"), c["_block"].alias("_block"))))
    meant = (F.col(scene) == F.col("_s")) & (in_block(idx) == F.col("_own"))
    looked = points.join(views, meant if needed is None else meant & needed, "left").drop("_s", "_own").withColumn("_seen", seen).drop("_boxes")
    looked = looked.withColumn("_near", F.array_min(F.transform("_seen", lambda c: c["end"])))
    left = F.transform(F.filter("_seen", lambda c: c["off"] < F.col("_near")), lambda c: c["_block"])
    some = looked.withColumn("_open", F.explode_outer(left)).drop("_seen")
    joined = some.join(p, (F.col(scene) == F.col("_s")) & (F.col("_open") == F.col("_block")) & (F.col("_i") >= F.col(idx)), "left")
    gap = square([F.col(x) - F.col(f"_p{k}") for k, x in enumerate(at)])
    rest = [c for c in points.columns if c not in keys]
    # columns one by one, not as a struct: buffers of numbers are updated in place by the hash aggregation
    return joined.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in rest], F.sqrt(F.min(F.least("_near", gap))).alias(name))


def folded_angle(a: list[Column], b: list[Column]) -> Column:
    """Angle of two vectors in degrees, 0 to 90; null where one is shorter than 0.01."""
    dots = lambda p, q: sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    na, nb = F.sqrt(dots(a, a)), F.sqrt(dots(b, b))
    cos = F.try_divide(dots(a, b), na * nb)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(cos, 12)))))
    return F.when((na >= 0.01) & (nb >= 0.01), F.least(angle, 180 - angle))
