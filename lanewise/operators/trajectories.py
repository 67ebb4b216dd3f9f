"""Trajectories of a scene's objects against the ego path, and the five questions asked of them.

``tracks`` is the common substrate, a row for each object and frame: scene_id, object_id, kind (display type), label, idx, n
(frames of the scene), x, y, z, speed, observed, visible, facing, ex, ey, ez, ego_speed, ux, uy, uz, lx, ly, lz (the pose's lateral axis),
lidar.
Every question is a filter and an aggregation on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import norm
from ..schema import APPROACH_BOUNDS
from . import sequence as s
from .sampling import draw


@dataclass(frozen=True)
class Config:
    """Fixed values of the questions: metres, metres a second, degrees."""

    near: float = 30.0
    ratio: float = 1.5
    moving: float = 2.8
    least_speed: float = 1.0
    towards: float = 0.3
    apart: float = -0.3
    apart_heading: float = -0.1
    in_a_row: int = 3
    rate: float = 2.8
    least_rate: float = 2.24
    lidar: int = 10
    parallel: float = 20.0
    perpendicular: float = 70.0
    path: float = 5.0
    forward: float = 0.3
    ego_speed: float = 5.0
    sign_rate: float = 0.5
    sign_alignment: float = 0.5
    far: tuple[float, float] = (2.0, 60.0)


DEFAULT = Config()
TRACK = ["scene_id", "object_id"]
#: Kinds that are asked how they move.
MOVERS = ("Vehicle", "Pedestrian", "Cyclist")


def tracks(frames: DataFrame, observations: DataFrame) -> DataFrame:
    """frames: scene_id, timestamp, ex, ey, ez, lx, ly, lz (ego position and lateral axis, the last and the second column of its pose).
    observations: scene_id, timestamp, object_id, kind, label, x, y, z, speed, lidar; and, where they are known, visible (some camera
    shows all of the object) and facing (its heading in the first camera that does).  What isn't known is visible, and faces the camera.

    Scenes with fewer than three frames are left out.  An object gets a row for every frame of its scene; positions and speed
    between its observations are interpolated.  An unknown speed is 0; an observation without a position keeps what it has
    and fills nothing in.
    kind and label are those of its last observation.  An object has one observation in a frame at most.

    Observations learn their frame and the observation after them first, which is work on the few rows that there are.  The grid of
    objects and frames is then shuffled and sorted once, with the observations as marks among its rows."""
    path = s.ego_motion(s.with_frame_index(frames, ["scene_id"], ["timestamp"]), ["scene_id"], ["timestamp"], ("ex", "ey", "ez"))
    path = path.withColumn("n", F.count("*").over(Window.partitionBy("scene_id"))).where("n >= 3")
    filled = ["x", "y", "z", "speed"]
    shown = {"visible": F.lit(True), "facing": F.lit("towards")}
    observations = observations.withColumns({c: F.coalesce(c, other) if c in observations.columns else other for c, other in shown.items()})
    point = F.when(F.col("x").isNotNull(), F.struct(*filled, F.col("timestamp").cast("double").alias("t"), "idx"))
    placed = observations.withColumn("speed", F.coalesce("speed", F.lit(0.0))).join(path.select("scene_id", "timestamp", "idx"), ["scene_id", "timestamp"], "left").withColumn("_p", point)
    known = placed.groupBy(*TRACK).agg(
        F.max_by(F.struct("kind", "label"), "timestamp").alias("a"), F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("idx"))).alias("_first")
    ).select(*TRACK, "a.*", "_first")
    after = F.lead("_p").over(Window.partitionBy(*TRACK, F.col("_p").isNull()).orderBy("idx"))
    marks = placed.where("idx is not null").withColumn("_next", after).select(*TRACK, "idx", F.struct("idx", "lidar", *shown, *filled).alias("_s"), F.when(F.col("_p").isNotNull(), F.struct("_p.*", "_next")).alias("_b"))
    both = path.join(known, "scene_id").withColumn("_grid", F.lit(True)).unionByName(marks.withColumn("_grid", F.lit(False)), allowMissingColumns=True)
    w = s.ordered(TRACK, ["idx", "_grid"]).rowsBetween(Window.unboundedPreceding, 0)
    v = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("_s", "_b")}).where("_grid")
    v = v.withColumns({"_a": F.when(F.col("_b").isNull(), F.col("_first")).otherwise(F.col("_b._next")), "observed": F.coalesce(F.col("_s.idx") == F.col("idx"), F.lit(False))})
    here, time = F.col("_b.idx") == F.col("idx"), F.col("timestamp").cast("double")
    own = lambda c: F.when(F.col("observed"), F.col("_s")[c])
    between = lambda c: s.between(F.lit(None), F.col("_b")[c], F.col("_b.t"), F.col("_a")[c], F.col("_a.t"), time)
    full = v.withColumns({c: F.when(here, F.col("_b")[c]).otherwise(F.coalesce(own(c), between(c))) for c in filled} | {"lidar": F.when(F.col("observed"), F.col("_s.lidar"))})
    full = full.withColumns({"visible": F.col("observed") & F.coalesce("_s.visible", F.lit(False)), "facing": F.when(F.col("observed"), F.col("_s.facing"))})
    return full.drop("_first", "_grid", "_s", "_b", "_a")


def distance() -> Column:
    return norm(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"), F.col("z") - F.col("ez"))


def faster_than_ego(t: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """scene_id, object_id, idx, answer: 'yes' at the frame of the largest ratio, 'no' at that of the largest inverse; of vehicles,
    pedestrians and cyclists.

    A frame in which the object isn't observed gives no row; if that is the 'yes' frame there is no 'no' row either."""
    ratio = F.round(F.col("speed") / (F.col("ego_speed") + 1e-6), 9)
    inverse = F.round(F.col("ego_speed") / (F.col("speed") + 1e-6), 9)
    near = t.where(F.col("kind").isin(*MOVERS)).withColumn("near", F.round(distance(), 9) < c.near)
    yes = near.withColumn("hit", F.col("near") & (ratio > c.ratio) & (F.col("speed") > c.moving))
    no = F.col("near") & (ratio <= c.ratio)
    both = yes.withColumns({"_no": no, "_ys": F.when(F.col("hit"), ratio).otherwise(0.0), "_ns": F.when(no, inverse).otherwise(0.0)})
    best = both.groupBy(*TRACK).agg(
        F.max_by(F.struct("idx", "observed"), F.struct("_ys", -F.col("idx"))).alias("y"), F.bool_or("hit").alias("any_y"),
        F.max_by(F.struct("idx", "observed"), F.struct("_ns", -F.col("idx"))).alias("n"), F.bool_or("_no").alias("any_n"),
    )
    out = best.select(*TRACK, F.explode(F.array(
        F.struct(F.lit("yes").alias("answer"), F.col("y.idx").alias("idx"), (F.col("any_y") & F.col("y.observed")).alias("ok")),
        F.struct(F.lit("no").alias("answer"), F.col("n.idx").alias("idx"), (F.col("any_n") & F.col("n.observed") & ~(F.col("any_y") & ~F.col("y.observed"))).alias("ok")),
    )).alias("r"))
    return out.where("r.ok").select(*TRACK, F.col("r.idx").alias("idx"), F.col("r.answer").alias("answer"))


def relative_motion(t: DataFrame) -> DataFrame:
    """Adds d, rate, c (convergence), ho and he (headings of object and ego towards each other)."""
    w = s.ordered(TRACK, ["idx"])
    series = ["d", "x", "y", "z", "ex", "ey", "ez"]
    # the rows before and after as one struct each
    v = t.withColumn("d", distance()).withColumns({"_b": F.lag(F.struct(*series)).over(w), "_a": F.lead(F.struct(*series)).over(w)})
    rate = lambda k: s.central(F.col("_b")[k], F.col(k), F.col("_a")[k])
    v = v.withColumns({f"v{k}": rate(k) for k in series[1:]} | {"rate": s.backward(F.col("_b.d"), F.col("d"))})
    vo, ve = [F.col(f"v{a}") for a in "xyz"], [F.col(f"ve{a}") for a in "xyz"]
    to_ego = [F.col(f"e{a}") - F.col(a) for a in "xyz"]
    unit = lambda p: [x / (norm(*p) + 1e-8) for x in p]
    dots = lambda p, q: sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    rel, to_object = [a - b for a, b in zip(vo, ve, strict=True)], [-x for x in to_ego]
    return v.withColumns({"c": dots(unit(rel), unit(to_ego)), "ho": dots(unit(vo), unit(to_ego)), "he": dots(unit(ve), unit(to_object))}).drop("_b", "_a", *[f"v{k}" for k in series[1:]])


def moving_towards_ego(t: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """scene_id, object_id, idx, scenario, answer ('yes' for approaching, 'no' for diverging): the pivotal frame of each.

    That frame is chosen among all frames, interpolated ones too; if the object isn't seen in it with enough LiDAR points, there is no
    row, not one of another frame."""
    # in the order that the windows below need, so that the rows are sorted once
    whole = s.ordered(TRACK, ["idx"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    some = F.max("speed").over(whole) > c.least_speed
    m = relative_motion(t.where(F.col("kind").isin(*APPROACH_BOUNDS) & F.col("label").isNotNull()).withColumn("_some", some).where("_some"))
    r9 = {k: F.round(k, 9) for k in ("d", "rate", "c", "ho", "he")}
    m = m.withColumns(r9)
    w = s.ordered(TRACK, ["idx"])
    d, rate, cc, ho, he = (F.col(k) for k in r9)
    lo = hi = F.lit(None)
    for kind, (a, b) in APPROACH_BOUNDS.items():
        lo, hi = F.when(F.col("kind") == kind, a).otherwise(lo), F.when(F.col("kind") == kind, b).otherwise(hi)
    near = (d < c.near) & (rate <= -c.rate) & ((cc > c.towards) | (ho > c.towards) | (he > c.towards))
    apart = (rate >= c.rate) & ((cc < c.apart) | ((ho < c.apart_heading) & (he < c.apart_heading)))
    m = m.withColumns({"_a": s.cumulative(near, w), "_b": s.cumulative(apart, w), "_near": near, "_apart": apart})
    strong = F.abs(rate) > c.least_rate
    yes = F.col("_near") & (F.col("_a") >= c.in_a_row) & strong & d.between(lo, hi)
    no = F.col("_apart") & (F.col("_b") >= c.in_a_row) & strong & (d > c.far[0]) & (d < c.far[1])
    score = F.round(F.greatest(F.lit(0.0), (50 - d) / 50) + F.least(F.abs(rate) / 5, F.lit(1.0)) + F.greatest(F.lit(0.0), -cc) + F.greatest(ho, he), 9)
    coming = F.when((cc < -0.95) & (ho > 0.95) & (he > 0.95), "head_on").when((ho > 0.6) & (he < 0.3), "object_approaching").when((he > 0.6) & (ho < 0.3), "ego_approaching").otherwise("general_convergence")
    going = F.when(cc > 0.7, "parallel_diverging").when(ho < -0.5, "object_diverging").when(he < -0.5, "ego_diverging").otherwise("general_divergence")
    picked = m.withColumns({"answer": F.when(yes, "yes").when(no, "no"), "score": score, "scenario": F.when(yes, coming).otherwise(going)})
    seen = F.col("visible") & (F.coalesce("lidar", F.lit(0)) >= c.lidar)
    asked = picked.where("answer is not null").select(*TRACK, "answer", "idx", "scenario", "score", seen.alias("seen"))
    return s.best_frame(asked, [*TRACK, "answer"], F.col("score"), ["idx"]).where("seen").drop("score", "seen")


def parallel_motion(t: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """scene_id, object_id, idx, answer ('parallel', 'perpendicular'), confidence: the surest observed frame of each vehicle, pedestrian
    and cyclist, by the angle in space between its motion to the next frame and the ego's."""
    w = s.ordered(TRACK, ["idx"])
    movers = t.where(F.col("kind").isin(*MOVERS)).withColumn("_a", F.lead(F.struct("x", "y", "z", "ex", "ey", "ez")).over(w))
    step = lambda *names: [F.col("_a")[k] - F.col(k) for k in names]
    a = movers.withColumn("angle", F.round(s.folded_angle(step("ex", "ey", "ez"), step("x", "y", "z")), 9))
    use = a.where((F.round(distance(), 9) < c.near) & (F.col("speed") > 2) & (F.round("ego_speed", 9) > 2) & (F.col("idx") < F.col("n") - 1) & F.col("angle").isNotNull() & F.col("observed") & F.col("label").isNotNull())
    answer = F.when(F.col("angle") < c.parallel, "parallel").when(F.col("angle") > c.perpendicular, "perpendicular")
    sure = F.when(F.col("angle") < c.parallel, (c.parallel - F.col("angle")) / c.parallel).otherwise((F.col("angle") - c.perpendicular) / 20)
    found = use.withColumns({"answer": answer, "confidence": F.round(sure, 9)}).where("answer is not null").select(*TRACK, "answer", "idx", "confidence")
    return s.best_frame(found, [*TRACK, "answer"], F.col("confidence"), ["idx"])


def approaching_stop_sign(t: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """scene_id, object_id, idx, answer of all frames that show a stop sign and a clear change of distance to it; 'yes' only if the ego heads
    for the sign and the sign faces the camera."""
    w = s.ordered(TRACK, ["idx"])
    m = t.where("label = 'Stop Sign'").withColumn("d", distance()).withColumn("rate", F.round(s.range_rate(F.col("d"), w), 9)).withColumn("d", F.round("d", 9))
    ahead = F.try_divide(F.col("ux") * (F.col("x") - F.col("ex")) + F.col("uy") * (F.col("y") - F.col("ey")) + F.col("uz") * (F.col("z") - F.col("ez")), F.col("d"))
    yes = (F.col("d") < c.near) & (F.col("rate") < -c.rate)
    no = (F.col("rate") > c.rate) | (F.col("d") >= c.near)
    towards = F.coalesce(F.round(ahead, 9) > c.sign_alignment, F.lit(False)) & (norm(F.col("ux"), F.col("uy"), F.col("uz")) >= 0.1)
    keep = F.col("visible") & (F.abs("rate") >= c.sign_rate)
    return m.withColumn("answer", F.when(yes, "yes").when(no, "no")).where(keep & ((F.col("answer") == "no") | ((F.col("answer") == "yes") & towards & (F.col("facing") == "towards")))).select(*TRACK, "idx", "answer")


def frames_without_sign(frames: DataFrame, t: DataFrame, near: float = 30.0) -> DataFrame:
    """Frames (scene_id, idx) with no sign of any kind within reach of its track."""
    with_sign = t.where("kind = 'Sign'").where(F.round(distance(), 9) < near).select("scene_id", "idx").distinct()
    return frames.select("scene_id", "idx").join(with_sign, ["scene_id", "idx"], "left_anti")


def future_path(t: DataFrame, c: Config = DEFAULT, seed: str = "path") -> DataFrame:
    """scene_id, object_id, idx, answer: vehicles ahead that are in the ego's lane or come close to where it will be, and others; one
    frame of each kind for an object, of those that some camera shows, and in each scene as many of one kind as of the other.

    Ahead: more than ``forward`` metres along the ego's direction.  The lane is as wide as the pose's lateral axis, half of it to each
    side of the ego.  Future distance is the least one, in the plane, from the vehicle's place to the ego's later positions."""
    rel = [F.col(a) - F.col(f"e{a}") for a in "xyz"]
    dots = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    ego_way, side = [F.col(f"u{a}") for a in "xyz"], [F.col(f"l{a}") for a in "xyz"]
    ahead = F.round(dots(rel, ego_way) / (norm(*ego_way) + 1e-6), 9) > c.forward
    # 0 at the right edge of the lane, 1 at the left one
    across = F.round(F.try_divide(dots(rel, side), dots(side, side)) + 0.5, 9)
    in_lane = F.coalesce((dots(side, side) > 1e-8) & across.between(0, 1), F.lit(False))
    v = t.where("kind = 'Vehicle' and visible").where(F.round(distance(), 9) < c.near)
    v = v.select(*TRACK, "idx", "x", "y", (ahead & (F.round("ego_speed", 9) > c.ego_speed)).alias("front"), in_lane.alias("in_lane"))
    ego = t.select("scene_id", "idx", "ex", "ey").distinct()
    # only what is in front and beside the lane needs the ego's later way
    found = s.suffix_minimum(v, ego, [*TRACK, "idx"], ("x", "y"), ("ex", "ey"), "future", F.col("front") & ~F.col("in_lane"))
    marked = found.withColumn("positive", F.col("front") & (F.col("in_lane") | F.coalesce(F.round("future", 9) < c.path, F.lit(False))))
    one = marked.groupBy(*TRACK, "positive").agg(F.min_by("idx", F.struct(draw(seed, *TRACK, "idx"), F.col("idx"))).alias("idx"))
    # two rows for each object; a scene has few objects
    rank = F.row_number().over(Window.partitionBy("scene_id", "positive").orderBy(draw(seed, *TRACK), "object_id"))
    scene = Window.partitionBy("scene_id")
    even = one.withColumns({"_r": rank, "_n": F.least(F.count_if("positive").over(scene), F.count_if(~F.col("positive")).over(scene))})
    return even.where("_r <= _n").select(*TRACK, "idx", F.when(F.col("positive"), "yes").otherwise("no").alias("answer"))
