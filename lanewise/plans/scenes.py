"""Queries on frames, with events as the stand-in: a user is a scene, an event a frame (by time and id), its type an observed object
whose value is seen on its own events only; the ego stands at (frame, event_id % 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import speed_band
from ..functions.text import camera_display, day_period, decimals, grouped
from ..operators import questions, scenes, trajectories
from ..operators import sequence as s
from ..schema import BANDS, bands
from ..sources import variants
from ..sources.tables import table
from ..streaming import scene_state
from .registry import query

FRAMES = """WITH frames AS (SELECT user_id AS scene_id, event_id, ts, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
  CAST(event_id % 13 AS DOUBLE) AS y FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "scene_id").select("scene_id", "event_id", "ts", "event_type", "value")
    return s.with_frame_index(e, ["scene_id"], ["ts", "event_id"]).withColumn("y", (F.col("event_id") % 13).cast("double"))


def by_frame():
    return s.ordered(["scene_id"], ["idx"])


@query(f"{FRAMES} SELECT scene_id, event_id, idx FROM frames")
def frame_index(spark, sf_dir):
    return frames(spark, sf_dir).select("scene_id", "event_id", "idx")


@query(f"{FRAMES}, m AS (SELECT *, max(idx) OVER (PARTITION BY scene_id) AS most FROM frames) SELECT scene_id, event_id, idx, CASE WHEN idx = 0 THEN least(1, most) ELSE idx END AS current_idx, greatest(CASE WHEN idx = 0 THEN least(1, most) ELSE idx END - 1, 0) AS previous_idx FROM m")
def previous_frame_pairs(spark, sf_dir):
    return s.previous_pairs(frames(spark, sf_dir), ["scene_id"]).select("scene_id", "event_id", "idx", "current_idx", "previous_idx")


@query(f"""{FRAMES}, d AS (SELECT scene_id, idx, coalesce(1.0 * (idx - lag(idx) OVER w), 0.0) AS dx, coalesce(y - lag(y) OVER w, 0.0) AS dy FROM frames WINDOW w AS (PARTITION BY scene_id ORDER BY idx)),
l AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM d)
SELECT scene_id, idx, round(len / 0.1, 6) AS ego_speed, round(CASE WHEN len > 1e-6 THEN dx / len ELSE 0.0 END, 6) AS ux, round(CASE WHEN len > 1e-6 THEN dy / len ELSE 0.0 END, 6) AS uy FROM l""")
def ego_kinematics(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"x": F.col("idx").cast("double"), "z": F.lit(0.0)})
    out = s.ego_motion(f, ["scene_id"], ["idx"], ("x", "y", "z"))
    return out.select("scene_id", "idx", *[F.round(c, 6).alias(c) for c in ("ego_speed", "ux", "uy")])


@query(f"{FRAMES} SELECT scene_id, idx, round(coalesce((value - lag(value) OVER (PARTITION BY scene_id ORDER BY idx)) / 0.1, 0.0), 6) AS rate FROM frames")
def range_rate(spark, sf_dir):
    return frames(spark, sf_dir).select("scene_id", "idx", F.round(s.range_rate(F.col("value"), by_frame()), 6).alias("rate"))


@query(f"""{FRAMES}, n AS (SELECT scene_id, idx, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM frames WINDOW w AS (PARTITION BY scene_id ORDER BY idx))
SELECT scene_id, idx, round(CASE WHEN a IS NULL THEN (b - value) / 0.1 WHEN b IS NULL THEN (value - a) / 0.1 ELSE (b - a) / 0.2 END, 6) AS velocity FROM n""")
def gradient_velocity(spark, sf_dir):
    return frames(spark, sf_dir).select("scene_id", "idx", F.round(s.gradient(F.col("value"), by_frame()), 6).alias("velocity"))


INTERPOLATED = """, g AS (SELECT scene_id, idx, CASE WHEN event_type = 'click' THEN value END AS v, CASE WHEN event_type = 'click' THEN epoch_us(ts) / 1000.0 END AS vt, epoch_us(ts) / 1000.0 AS t FROM frames),
h AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(vt IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(vt IGNORE NULLS) OVER a AS t1 FROM g
  WINDOW b AS (PARTITION BY scene_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY scene_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT scene_id, idx, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM h)"""


@query(f"{FRAMES}{INTERPOLATED} SELECT scene_id, idx, round(value, 4) AS value FROM i")
def interpolate_trajectory(spark, sf_dir):
    time = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0
    seen = F.when(F.col("event_type") == "click", F.col("value"))
    f = frames(spark, sf_dir).withColumns({"seen": seen, "t": time})
    return f.select("scene_id", "idx", F.round(s.interpolated(F.col("seen"), F.col("t"), ["scene_id"], ["idx"]), 4).alias("value"))


@query(f"{FRAMES} SELECT scene_id, idx, CAST(count(*) FILTER (WHERE value > 10) OVER (PARTITION BY scene_id ORDER BY idx) AS BIGINT) AS so_far, (count(*) FILTER (WHERE value > 10) OVER (PARTITION BY scene_id ORDER BY idx)) >= 3 AS consistent FROM frames")
def cumulative_consistency(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("so_far", s.cumulative(F.col("value") > 10, by_frame()))
    return f.select("scene_id", "idx", "so_far", (F.col("so_far") >= 3).alias("consistent"))


@query(f"{FRAMES} SELECT a.scene_id, a.idx, round(min(sqrt((a.value - b.idx) * (a.value - b.idx) + (a.y - b.y) * (a.y - b.y))), 6) AS min_distance FROM frames a JOIN frames b ON a.scene_id = b.scene_id AND b.idx >= a.idx GROUP BY a.scene_id, a.idx")
def suffix_min_distance(spark, sf_dir):
    f = frames(spark, sf_dir).select("scene_id", "idx", "value", "y")
    path = f.select("scene_id", "idx", F.col("idx").cast("double").alias("px"), F.col("y").alias("py"))
    return s.suffix_minimum(f, path, ["scene_id", "idx"], ("value", "y"), ("px", "py")).select("scene_id", "idx", F.round("min_distance", 6).alias("min_distance"))


@query(f"""{FRAMES}, v AS (SELECT scene_id, idx, 1.0 AS ax, lead(y) OVER w - y AS ay, lead(value) OVER w - value AS bx, 1.0 AS by_ FROM frames WINDOW w AS (PARTITION BY scene_id ORDER BY idx)),
c AS (SELECT scene_id, idx, degrees(acos(greatest(-1.0, least(1.0, round((ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)), 12))))) AS a FROM v WHERE ay IS NOT NULL AND sqrt(bx * bx + by_ * by_) >= 0.01)
SELECT scene_id, idx, round(least(a, 180 - a), 5) AS angle, CASE WHEN round(least(a, 180 - a), 5) < 20 THEN 'parallel' WHEN round(least(a, 180 - a), 5) > 70 THEN 'perpendicular' ELSE 'neither' END AS kind FROM c""")
def motion_angle_parallel_perpendicular(spark, sf_dir):
    f = frames(spark, sf_dir)
    lead = lambda c: F.lead(c).over(by_frame()) - F.col(c)
    a = f.select("scene_id", "idx", F.round(s.folded_angle([F.lit(1.0), lead("y")], [lead("value"), F.lit(1.0)]), 5).alias("angle")).where("angle is not null")
    return a.withColumn("kind", F.when(F.col("angle") < 20, "parallel").when(F.col("angle") > 70, "perpendicular").otherwise("neither"))


# trajectory questions: frames at whole seconds, the ego moves 1 along x a frame, an object stands at (value, event_id % 7), the lateral axis is
# (event_id % 5 / 4 - 0.5, 1)
KINDS = {"click": "Vehicle", "view": "Pedestrian", "purchase": "Cyclist", "error": "Sign", "scroll": "Vehicle"}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("timestamp", F.col("idx").cast("long"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.col("event_type")], F.lit("Vehicle"))
    label = F.when(kind == "Sign", F.lit("Stop Sign")).otherwise(F.concat(F.lit("a "), F.lower(kind)))
    seen = f.select(
        "scene_id", "timestamp", F.col("event_type").alias("object_id"), kind.alias("kind"), label.alias("label"), F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"),
        F.lit(0.0).alias("z"), (F.col("value") / 4).alias("speed"), (F.col("event_id") % 23).cast("int").alias("lidar"), (F.col("event_id") % 11 != 4).alias("visible"),
        F.when(F.col("event_id") % 3 == 0, "away").otherwise("towards").alias("facing"),
    )
    path = f.select("scene_id", "timestamp", F.col("idx").cast("double").alias("ex"), (F.col("y") / 13).alias("ey"), F.lit(0.0).alias("ez"), ((F.col("event_id") % 5) / 4 - 0.5).alias("lx"), F.lit(1.0).alias("ly"), F.lit(0.0).alias("lz"))
    return trajectories.tracks(path, seen)


TRACKS = f"""{FRAMES}, kinds AS (SELECT *, CASE event_type WHEN 'view' THEN 'Pedestrian' WHEN 'purchase' THEN 'Cyclist' WHEN 'error' THEN 'Sign' ELSE 'Vehicle' END AS kind FROM frames),
p0 AS (SELECT scene_id, idx, 1.0 * idx AS ex, y / 13 AS ey, CAST(event_id % 5 AS DOUBLE) / 4 - 0.5 AS lx, CAST(1.0 AS DOUBLE) AS ly, count(*) OVER (PARTITION BY scene_id) AS n FROM frames),
p1 AS (SELECT *, coalesce(ex - lag(ex) OVER w, 0.0) AS dx, coalesce(ey - lag(ey) OVER w, 0.0) AS dy FROM p0 WINDOW w AS (PARTITION BY scene_id ORDER BY idx)),
path AS (SELECT scene_id, idx, n, ex, ey, lx, ly, sqrt(dx * dx + dy * dy) / 0.1 AS ego_speed, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0.0 END AS ux,
  CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0.0 END AS uy FROM p1 WHERE n >= 3),
objects AS (SELECT DISTINCT scene_id, event_type AS object_id, kind FROM kinds),
t0 AS (SELECT p.*, o.object_id, o.kind, k.value AS sx, CAST(k.event_id % 7 AS DOUBLE) AS sy, k.value / 4 AS ss, CASE WHEN k.idx IS NOT NULL THEN 1.0 * k.idx END AS st, k.event_id AS seen_id FROM path p JOIN objects o ON p.scene_id = o.scene_id
  LEFT JOIN kinds k ON k.scene_id = p.scene_id AND k.event_type = o.object_id AND k.idx = p.idx),
t1 AS (SELECT *, last_value(st IGNORE NULLS) OVER b AS a0, first_value(st IGNORE NULLS) OVER a AS a1, last_value(sx IGNORE NULLS) OVER b AS x0, first_value(sx IGNORE NULLS) OVER a AS x1,
  last_value(sy IGNORE NULLS) OVER b AS y0, first_value(sy IGNORE NULLS) OVER a AS y1, last_value(ss IGNORE NULLS) OVER b AS s0, first_value(ss IGNORE NULLS) OVER a AS s1 FROM t0
  WINDOW b AS (PARTITION BY scene_id, object_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY scene_id, object_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT scene_id, object_id, kind, CASE WHEN kind = 'Sign' THEN 'Stop Sign' ELSE 'a ' || lower(kind) END AS label, idx, n, ex, ey, lx, ly, ego_speed, ux, uy, sx IS NOT NULL AS observed,
  coalesce(seen_id % 11 <> 4, false) AS visible, coalesce(seen_id % 23, 0) >= 10 AS measured, coalesce(seen_id % 3 <> 0, false) AS facing, {', '.join(f"CASE WHEN s{c} IS NOT NULL THEN s{c} WHEN {c}0 IS NULL THEN {c}1 WHEN {c}1 IS NULL THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * (idx - a0) / (a1 - a0) END AS {n}" for c, n in (("x", "x"), ("y", "y"), ("s", "speed")))} FROM t1),
d AS (SELECT *, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS dist FROM t)"""


@query(f"{TRACKS} SELECT scene_id, object_id, idx, observed, visible, round(x + 1e-9, 5) AS x, round(y + 1e-9, 5) AS y, round(speed + 1e-9, 5) AS speed, round(ego_speed + 1e-9, 5) AS ego_speed FROM t")
def trajectory_substrate(spark, sf_dir):
    return tracks(spark, sf_dir).select("scene_id", "object_id", "idx", "observed", "visible", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("x", "y", "speed", "ego_speed")])


@query(f"""{TRACKS}, f AS (SELECT *, round(dist, 9) < 30 AS near, round(speed / (ego_speed + 1e-6), 9) AS r, round(ego_speed / (speed + 1e-6), 9) AS inv FROM d WHERE kind IN ('Vehicle', 'Pedestrian', 'Cyclist')),
g AS (SELECT *, near AND r > 1.5 AND speed > 2.8 AS ys, near AND r <= 1.5 AS ns FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id ORDER BY CASE WHEN ys THEN r ELSE 0.0 END DESC, idx) AS yr, row_number() OVER (PARTITION BY scene_id, object_id ORDER BY CASE WHEN ns THEN inv ELSE 0.0 END DESC, idx) AS nr FROM g),
o AS (SELECT scene_id, object_id, bool_or(ys) AS ay, bool_or(ns) AS an, max(idx) FILTER (WHERE yr = 1) AS yi, bool_or(observed) FILTER (WHERE yr = 1) AS yo, max(idx) FILTER (WHERE nr = 1) AS ni, bool_or(observed) FILTER (WHERE nr = 1) AS no_ FROM b GROUP BY ALL)
SELECT scene_id, object_id, yi AS idx, 'yes' AS answer FROM o WHERE ay AND yo UNION ALL SELECT scene_id, object_id, ni, 'no' FROM o WHERE an AND no_ AND NOT (ay AND NOT yo)""")
def faster_than_ego(spark, sf_dir):
    return trajectories.faster_than_ego(tracks(spark, sf_dir))


MOTION = f"""{TRACKS}, s0 AS (SELECT *, max(speed) OVER (PARTITION BY scene_id, object_id) AS top FROM d WHERE kind IN ('Vehicle', 'Pedestrian', 'Cyclist')),
s1 AS (SELECT *, coalesce((dist - lag(dist) OVER w) / 0.1, 0.0) AS rate0,
  {', '.join(f"CASE WHEN lag({c}) OVER w IS NULL THEN (lead({c}) OVER w - {c}) / 0.1 WHEN lead({c}) OVER w IS NULL THEN ({c} - lag({c}) OVER w) / 0.1 ELSE (lead({c}) OVER w - lag({c}) OVER w) / 0.2 END AS v{c}" for c in ("x", "y", "ex", "ey"))}
  FROM s0 WHERE top > 1.0 WINDOW w AS (PARTITION BY scene_id, object_id ORDER BY idx)),
s2 AS (SELECT *, sqrt(vx * vx + vy * vy) + 1e-8 AS no, sqrt(vex * vex + vey * vey) + 1e-8 AS ne, sqrt((vx - vex) * (vx - vex) + (vy - vey) * (vy - vey)) + 1e-8 AS nr FROM s1),
m AS (SELECT scene_id, object_id, kind, idx, visible AND measured AS seen, round(dist, 9) AS d, round(rate0, 9) AS rate, round(((vx - vex) / nr) * ((ex - x) / (dist + 1e-8)) + ((vy - vey) / nr) * ((ey - y) / (dist + 1e-8)), 9) AS c,
  round((vx / no) * ((ex - x) / (dist + 1e-8)) + (vy / no) * ((ey - y) / (dist + 1e-8)), 9) AS ho, round((vex / ne) * ((x - ex) / (dist + 1e-8)) + (vey / ne) * ((y - ey) / (dist + 1e-8)), 9) AS he FROM s2)"""


@query(f"{MOTION} SELECT scene_id, object_id, idx, round(d, 5) + 0.0 AS d, round(rate, 5) + 0.0 AS rate, round(c, 5) + 0.0 AS c, round(ho, 5) + 0.0 AS ho, round(he, 5) + 0.0 AS he FROM m WHERE kind <> 'Sign'")
def relative_motion(spark, sf_dir):
    t = tracks(spark, sf_dir)
    some = F.max("speed").over(Window.partitionBy("scene_id", "object_id")) > 1.0
    m = trajectories.relative_motion(t.where("kind <> 'Sign'").withColumn("some", some).where("some"))
    return m.select("scene_id", "object_id", "idx", *[(F.round(F.round(c, 9), 5) + 0.0).alias(c) for c in ("d", "rate", "c", "ho", "he")])


@query(f"""{MOTION}, q AS (SELECT *, d < 30 AND rate <= -2.8 AND (c > 0.3 OR ho > 0.3 OR he > 0.3) AS near, rate >= 2.8 AND (c < -0.3 OR (ho < -0.1 AND he < -0.1)) AS apart FROM m),
r AS (SELECT *, count(*) FILTER (WHERE near) OVER w AS ca, count(*) FILTER (WHERE apart) OVER w AS cb, CASE kind WHEN 'Pedestrian' THEN 10 WHEN 'Cyclist' THEN 15 ELSE 25 END AS hi FROM q WINDOW w AS (PARTITION BY scene_id, object_id ORDER BY idx)),
a AS (SELECT *, CASE WHEN near AND ca >= 3 AND abs(rate) > 2.24 AND d BETWEEN 2 AND hi THEN 'yes' WHEN apart AND cb >= 3 AND abs(rate) > 2.24 AND d > 2 AND d < 60 THEN 'no' END AS answer,
  round(greatest(0.0, (50 - d) / 50) + least(abs(rate) / 5, 1.0) + greatest(0.0, -c) + greatest(ho, he), 9) AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id, answer ORDER BY score DESC, idx) AS rn FROM a WHERE answer IS NOT NULL)
SELECT scene_id, object_id, answer, idx, CASE WHEN answer = 'yes' THEN CASE WHEN c < -0.95 AND ho > 0.95 AND he > 0.95 THEN 'head_on' WHEN ho > 0.6 AND he < 0.3 THEN 'object_approaching' WHEN he > 0.6 AND ho < 0.3 THEN 'ego_approaching' ELSE 'general_convergence' END
  ELSE CASE WHEN c > 0.7 THEN 'parallel_diverging' WHEN ho < -0.5 THEN 'object_diverging' WHEN he < -0.5 THEN 'ego_diverging' ELSE 'general_divergence' END END AS scenario FROM k WHERE rn = 1 AND seen""")
def moving_towards_ego(spark, sf_dir):
    return trajectories.moving_towards_ego(tracks(spark, sf_dir))


@query(f"""{TRACKS}, v AS (SELECT *, lead(ex) OVER w - ex AS ax, lead(ey) OVER w - ey AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM d WHERE kind IN ('Vehicle', 'Pedestrian', 'Cyclist') WINDOW w AS (PARTITION BY scene_id, object_id ORDER BY idx)),
c AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, round((ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)), 12))))) AS a0 FROM v
  WHERE round(dist, 9) < 30 AND speed > 2 AND round(ego_speed, 9) > 2 AND idx < n - 1 AND observed AND sqrt(ax * ax + ay * ay) >= 0.01 AND sqrt(bx * bx + by_ * by_) >= 0.01),
e AS (SELECT *, round(least(a0, 180 - a0), 9) AS a FROM c),
k AS (SELECT scene_id, object_id, idx, CASE WHEN a < 20 THEN 'parallel' WHEN a > 70 THEN 'perpendicular' END AS answer, round(CASE WHEN a < 20 THEN (20 - a) / 20 ELSE (a - 70) / 20 END, 9) AS confidence FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id, answer ORDER BY confidence DESC, idx) AS rn FROM k WHERE answer IS NOT NULL)
SELECT scene_id, object_id, answer, idx, round(confidence, 5) AS confidence FROM r WHERE rn = 1""")
def parallel_motion(spark, sf_dir):
    return trajectories.parallel_motion(tracks(spark, sf_dir)).withColumn("confidence", F.round("confidence", 5))


@query(f"""{TRACKS}, r AS (SELECT *, round(coalesce((dist - lag(dist) OVER w) / 0.1, 0.0), 9) AS rate FROM d WHERE label = 'Stop Sign' WINDOW w AS (PARTITION BY scene_id, object_id ORDER BY idx)),
a AS (SELECT *, CASE WHEN round(dist, 9) < 30 AND rate < -2.8 THEN 'yes' WHEN rate > 2.8 OR round(dist, 9) >= 30 THEN 'no' END AS answer, round((ux * (x - ex) + uy * (y - ey)) / nullif(round(dist, 9), 0), 9) AS ahead FROM r)
SELECT scene_id, object_id, idx, answer FROM a WHERE visible AND abs(rate) >= 0.5 AND (answer = 'no' OR (answer = 'yes' AND facing AND ahead > 0.5 AND sqrt(ux * ux + uy * uy) >= 0.1))""")
def approaching_stop_sign(spark, sf_dir):
    return trajectories.approaching_stop_sign(tracks(spark, sf_dir))


@query(f"{TRACKS} SELECT scene_id, idx FROM path EXCEPT SELECT scene_id, idx FROM d WHERE kind = 'Sign' AND round(dist, 9) < 30")
def frames_without_sign(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return trajectories.frames_without_sign(t.select("scene_id", "idx").distinct(), t)


@query(f"""{TRACKS}, v AS (SELECT * FROM d WHERE kind = 'Vehicle' AND round(dist, 9) < 30),
g AS (SELECT v.scene_id, v.object_id, v.idx, min(sqrt((v.x - p.ex) * (v.x - p.ex) + (v.y - p.ey) * (v.y - p.ey))) AS future FROM v JOIN path p ON v.scene_id = p.scene_id AND p.idx >= v.idx GROUP BY ALL),
m AS (SELECT v.scene_id, v.object_id, v.idx, v.visible, round(((x - ex) * ux + (y - ey) * uy) / (sqrt(ux * ux + uy * uy) + 1e-6), 9) > 0.3 AND round(ego_speed, 9) > 5
  AND (round(((x - ex) * lx + (y - ey) * ly) / (lx * lx + ly * ly) + 0.5, 9) BETWEEN 0 AND 1 OR round(future, 9) < 5) AS positive FROM v JOIN g ON v.scene_id = g.scene_id AND v.object_id = g.object_id AND v.idx = g.idx),
o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id, positive ORDER BY md5('path|' || scene_id || '|' || object_id || '|' || idx), idx) AS rn FROM m WHERE visible),
e AS (SELECT *, row_number() OVER (PARTITION BY scene_id, positive ORDER BY md5('path|' || scene_id || '|' || object_id), object_id) AS r2, least(count(*) FILTER (WHERE positive) OVER (PARTITION BY scene_id), count(*) FILTER (WHERE NOT positive) OVER (PARTITION BY scene_id)) AS cap FROM o WHERE rn = 1)
SELECT scene_id, object_id, idx, CASE WHEN positive THEN 'yes' ELSE 'no' END AS answer FROM e WHERE r2 <= cap""")
def vehicle_future_path(spark, sf_dir):
    return trajectories.future_path(tracks(spark, sf_dir))


@query(f"{FRAMES} SELECT scene_id, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY value DESC, idx) AS r FROM frames) WHERE r = 1")
def pivotal_frame_argmax(spark, sf_dir):
    f = frames(spark, sf_dir).select("scene_id", "idx", "value")
    return s.best_frame(f, ["scene_id"], F.col("value"), ["idx"])


@query("""SELECT object_id, scene_id, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id ORDER BY score DESC, idx) AS r FROM (
  SELECT user_id AS scene_id, event_type AS object_id, event_id AS idx, round(value * (event_id % 5), 6) AS score FROM events)) WHERE r = 1 AND score > 0""")
def best_view_per_object(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), F.col("event_type").alias("object_id"), F.col("event_id").alias("idx"), F.round(F.col("value") * (F.col("event_id") % 5), 6).alias("score"))
    return scenes.best_views(e, ["scene_id", "object_id"], "score", ["idx"])


@query("""SELECT CASE WHEN l_returnflag = 'N' THEN 'no_camera_name' WHEN l_linenumber NOT IN (1, 2, 3) THEN 'unknown_or_sign' WHEN NOT l_quantity <= 20 THEN 'too_far' WHEN NOT l_discount * 200 >= 10 THEN 'few_points'
  WHEN l_linestatus <> 'F' THEN 'no_camera' WHEN NOT l_tax > 0 THEN 'not_visible' ELSE 'passed' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def failure_reason_counts(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST", "TYPE_SIGN"])), F.least("l_linenumber", F.lit(4)))
    rules = scenes.best_view_rules(kind, F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.col("l_quantity"), F.col("l_discount") * 200, F.col("l_linestatus") == "F", F.col("l_tax"))
    return scenes.failure_counts(table(spark, sf_dir, "lineitem"), rules)


BAND = "CASE WHEN {v} >= 0 AND {v} <= 2.8 THEN 'stationary' WHEN {v} >= 2.8 AND {v} <= 11.11 THEN 'slow speed' WHEN {v} >= 11.11 AND {v} <= 19.44 THEN 'medium speed' WHEN {v} >= 19.44 THEN 'highway speed' ELSE 'stationary' END"


@query(f"SELECT event_id, {BAND.format(v='value')} AS band FROM events")
def speed_band_case(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", speed_band(F.lit("TYPE_VEHICLE"), F.col("value")).alias("band"))


@query(f"WITH b(band, lo, hi) AS (VALUES {', '.join(f'({n!r}, {lo}, {hi if hi < 1e9 else 1e18})' for n, lo, hi in BANDS['TYPE_VEHICLE'])}) SELECT b.band, count(*) AS n, round(avg(value), 6) AS mean FROM events JOIN b ON value BETWEEN lo AND hi GROUP BY b.band")
def speed_band_range_join(spark, sf_dir):
    # four rows of a constant dimension
    dim = F.broadcast(bands(spark).where("type = 'TYPE_VEHICLE'"))
    return table(spark, sf_dir, "events").join(dim, F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT user_id, event_type, arg_min(value, event_id) AS value, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS timestamps FROM events GROUP BY ALL""")
def scene_object_table(spark, sf_dir):
    out = scenes.scene_objects(table(spark, sf_dir, "events"), "user_id", "event_type", ["event_id"], ["value"])
    return out.withColumn("timestamps", F.array_join(F.transform("timestamps", lambda x: x.cast("string")), ","))


@query("""SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE value > 40)), ','), '') AS high, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE NOT value > 40)), ','), '') AS low FROM events GROUP BY user_id""")
def scene_id_lists(spark, sf_dir):
    out = scenes.id_lists(table(spark, sf_dir, "events"), "user_id", "event_type", {"high": F.col("value") > 40, "low": ~(F.col("value") > 40)})
    return out.withColumns({c: F.array_join(c, ",") for c in ("high", "low")})


@query("SELECT user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_attributes(spark, sf_dir):
    return scenes.last_attributes(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "props"])


@query("SELECT l_orderkey, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY ALL")
def first_visible_camera(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    return scenes.first_visible(rows, ["l_orderkey", "l_partkey"], "l_suppkey", F.col("s_acctbal") > 0).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT s_suppkey, n_name AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def label_dictionary_left_join(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("label"))


@query("""SELECT o_orderkey, coalesce(v, '') AS visible FROM orders LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS v FROM lineitem WHERE l_discount * 200 >= 10 AND l_quantity <= 20 AND l_returnflag <> 'N' GROUP BY 1) ON o_orderkey = l_orderkey""")
def co_visible_objects(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = scenes.co_visible(f, table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", F.col("l_quantity"), F.col("l_discount") * 200, F.when(F.col("l_returnflag") != "N", F.lit("c")))
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.array_join(F.transform("visible", lambda x: x.cast("string")), ",").alias("visible"))


ZONE_OF = ["America/Los_Angeles", "America/Phoenix", "America/Detroit", "UTC"]


@query("""WITH h AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'America/Los_Angeles' WHEN 1 THEN 'America/Phoenix' WHEN 2 THEN 'America/Detroit' ELSE 'UTC' END AS zone, ts FROM events),
l AS (SELECT event_id, hour(timezone(zone, timezone('UTC', ts))) AS h FROM h)
SELECT event_id, CASE WHEN h >= 5 AND h < 8 THEN 'Early Morning (5-8 AM)' WHEN h >= 8 AND h < 11 THEN 'Morning (8-11 AM)' WHEN h >= 11 AND h < 13 THEN 'Midday (11 AM-1 PM)' WHEN h >= 13 AND h < 17 THEN 'Afternoon (1-5 PM)'
  WHEN h >= 17 AND h < 20 THEN 'Evening (5-8 PM)' ELSE 'Night (8 PM-5 AM)' END AS period FROM l""")
def day_period_by_timezone(spark, sf_dir):
    zone = F.element_at(F.array(*map(F.lit, ZONE_OF)), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", day_period(F.unix_micros(F.col("ts").cast("timestamp")), zone).alias("period"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_metadata_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of samples in turn: two that are typed, one with a field of another type, and three for the quarantine."""
    k = F.col("event_id") % 6
    kind = F.when(k == 3, "hologram").when(k == 0, "single_image_multi_choice").when(k == 1, "multi_frame_multi_choice").when(k == 2, "single_image")
    stamp = F.when(k == 2, F.lit('"late"')).otherwise(F.col("event_id").cast("string"))
    text = F.format_string('{"question_type": "%s", "question": "is %s?", "timestamp": %s, "current_timestamp": %s, "choices": ["yes", "%s"], "extra": {"k": %s}}', kind, F.col("event_type"), stamp, F.col("event_id").cast("string"), F.col("event_type"), k.cast("string"))
    question = F.when(k == 4, F.lit('{"question_type": "single_image", ')).when(k == 5, F.lit('{"question": "?"}')).otherwise(text)
    answer = F.when(F.col("event_id") % 7 == 0, F.lit('{"answer_type": "guess"}')).otherwise(F.lit('{"answer_type": "multiple_choice", "answer": "yes", "choices": ["yes", "no"]}'))
    return variants.parsed(table(spark, sf_dir, "events").select("event_id", question.alias("question"), answer.alias("answer")))


@query("""SELECT event_id, 'is ' || event_type || '?' AS text, event_id AS timestamp, 'yes,' || event_type AS choices, CAST(event_id % 6 AS INTEGER) AS extra, 'yes' AS answer FROM events WHERE event_id % 6 < 2 AND event_id % 7 <> 0
UNION ALL SELECT event_id, 'is ' || event_type || '?', -1, 'none', 2, 'yes' FROM events WHERE event_id % 6 = 2 AND event_id % 7 <> 0""")
def typed_samples(spark, sf_dir):
    """Views of three kinds, with a field that no schema names, and their answers; -1 and "none" for a time of another type and no choices."""
    good = variants.accepted(samples(spark, sf_dir))
    out = None
    for kind, stamp, choices in (("single_image_multi_choice", "question_timestamp", True), ("multi_frame_multi_choice", "question_current_timestamp", True), ("single_image", "question_timestamp", False)):
        v = variants.view(variants.view(good, kind), "multiple_choice", "answer")
        part = v.select(
            "event_id", F.col("question_question").alias("text"), F.coalesce(stamp, F.lit(-1)).cast("long").alias("timestamp"), (F.array_join("question_choices", ",") if choices else F.lit("none")).alias("choices"),
            F.variant_get(F.col("question"), "$.extra.k", "int").alias("extra"), F.col("answer_answer").alias("answer"),
        )
        out = part if out is None else out.union(part)
    return out


@query("""SELECT CASE event_id % 6 WHEN 3 THEN 'unknown type of question: hologram' WHEN 4 THEN 'the question isn''t JSON' WHEN 5 THEN 'the question has no type' ELSE 'unknown type of answer: guess' END AS problem, count(*) AS n
FROM events WHERE event_id % 6 > 2 OR event_id % 7 = 0 GROUP BY 1""")
def quarantined_samples(spark, sf_dir):
    return variants.quarantined(samples(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


def _utc(df):
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c).cast("string")) for c in ("start", "end")}).withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    return _utc(scene_state.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", None, ["event_type"], "value"))


@query("""SELECT b - INTERVAL (k * 30) MINUTE AS start, b - INTERVAL (k * 30) MINUTE + INTERVAL '1 hour' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, * FROM events) CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def window_sliding(spark, sf_dir):
    return _utc(scene_state.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value"))


@query("""WITH l AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, sid""")
def window_session(spark, sf_dir):
    return _utc(scene_state.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], "value"))


@query("SELECT user_id, event_type, arg_min(value, event_id) AS value, min(event_id) AS first_time, max(event_id) AS last_time, count(*) AS n_frames FROM events GROUP BY ALL")
def incremental_scene_state(spark, sf_dir):
    return scene_state.object_state(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ["value"])


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of five parts of the events, merged."""
    e = table(spark, sf_dir, "events")
    flags = {"high": F.col("value") > 95, "even": F.col("event_id") % 64 == 0}
    parts = None
    for k in range(5):
        part = scene_state.partial_state(e.where(F.col("event_id") % 5 == k), "user_id", "event_type", "event_id", ["value"], flags)
        parts = part if parts is None else parts.union(part)
    return scene_state.merged_state(parts, "user_id", "event_type", list(flags))


@query("SELECT user_id, event_type, min(event_id) AS first_time, arg_min(value, event_id) AS value, max(event_id) AS last_time, count(*) AS n_frames, array_to_string(list_sort(list(event_id)), ',') AS timestamps FROM events GROUP BY ALL")
def merged_scene_state(spark, sf_dir):
    return merged(spark, sf_dir).select("user_id", "event_type", "first.first_time", "first.value", "last_time", "n_frames", F.array_join(F.col("timestamps").cast("array<string>"), ",").alias("timestamps"))


@query("""WITH o AS (SELECT user_id, event_type, coalesce(bool_or(value > 95), false) AS high, bool_or(event_id % 64 = 0) AS even FROM events GROUP BY ALL)
SELECT user_id, """ + ", ".join(f"coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE {c}), '') AS {n}" for n, c in (("high", "high"), ("no_high", "NOT high"), ("even", "even"), ("no_even", "NOT even"))) + " FROM o GROUP BY user_id")
def merged_scene_lists(spark, sf_dir):
    out = scene_state.id_lists(merged(spark, sf_dir), "user_id", "event_type", ["high", "even"])
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("high", "no_high", "even", "no_even")])




@query(f"{FRAMES}, e AS (SELECT scene_id, event_type, arg_min(value, idx) AS v0, arg_min(y, idx) AS y0, arg_max(value, idx) AS v1, arg_max(y, idx) AS y1, count(*) AS n FROM frames GROUP BY ALL) SELECT scene_id, event_type, round(sqrt((v1 - v0) * (v1 - v0) + (y1 - y0) * (y1 - y0)) / (n * 0.1), 6) AS mean_speed FROM e")
def mean_speed(spark, sf_dir):
    out = scenes.mean_speed(frames(spark, sf_dir), ["scene_id", "event_type"], "idx", ("value", "y"), 0.1)
    return out.withColumn("mean_speed", F.round("mean_speed", 6))


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 3 AND event_type = 'click' ORDER BY ts, event_id LIMIT 1")
def object_lookup(spark, sf_dir):
    return scenes.lookup(table(spark, sf_dir, "events"), ["ts", "event_id"], user_id=3, event_type="click").select("event_id", "user_id", "value")


@query("SELECT o_orderkey AS scene_id, l_linenumber AS name, l_suppkey AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def frame_fan_out(spark, sf_dir):
    """Orders as frames that nest their lines as cameras, flattened again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("name"), F.col("l_suppkey").alias("path"))).alias("images"))
    none = F.array().cast("array<struct<id: string, path: string>>")
    frames = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("scene_id"), F.lit(0).cast("long").alias("timestamp"), "images", none.alias("point_clouds"), none.alias("objects"))
    return scenes.fan_out(frames)["cameras"].select("scene_id", "name", "path")


@query("SELECT p_partkey, lower(replace(p_brand || '_' || p_type, '_', ' ')) AS camera, CASE WHEN p_size % 2 = 0 THEN p_name || '.jpg' ELSE p_type || '.jpg' END AS image FROM part")
def camera_images(spark, sf_dir):
    """The image of a named camera, of the front one where none is named, and the camera's name as shown."""
    name = F.when(F.col("p_size") % 2 == 0, F.lit("SIDE"))
    image = questions.best_image(F.array(F.concat("p_name", F.lit(".jpg")), F.concat("p_type", F.lit(".jpg"))), F.array(F.lit("SIDE"), F.lit("FRONT")), name)
    return table(spark, sf_dir, "part").select("p_partkey", camera_display(F.concat_ws("_", "p_brand", "p_type")).alias("camera"), image.alias("image"))


@query("SELECT user_id AS scene_id, event_id // 1000 AS timestamp, CAST(row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id) - 1 AS INTEGER) AS pos, event_id AS id, value FROM events WHERE event_id % 5 <> 0")
def frame_objects(spark, sf_dir):
    """A frame is a thousand events of a user and lists four fifths of them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), F.floor(F.col("event_id") / 1000).alias("timestamp"), F.col("event_id").alias("id"), "value")
    frames = e.where("id % 5 <> 0").groupBy("scene_id", "timestamp").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("objects"))
    return scenes.frame_objects(frames, e).select("scene_id", "timestamp", "pos", "id", "value")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'FRONT' ELSE 'SIDE' END AS camera, CAST(event_id % 3 AS INTEGER) AS pos FROM events WHERE event_id % 3 < 2")
def most_visible_camera(spark, sf_dir):
    """Each frame has three cameras, two of one name; a third of the objects names one that isn't there."""
    e = table(spark, sf_dir, "events")
    objects = e.select(F.col("user_id").alias("scene_id"), F.floor(F.col("event_id") / 1000).alias("timestamp"), F.col("event_id").alias("id"), F.element_at(F.array(F.lit("FRONT"), F.lit("SIDE"), F.lit("REAR")), (F.col("event_id") % 3 + 1).cast("int")).alias("most_visible_camera_name"))
    cams = objects.select("scene_id", "timestamp").distinct().select("scene_id", "timestamp", F.posexplode(F.array(F.lit("FRONT"), F.lit("SIDE"), F.lit("FRONT"))).alias("pos", "name"))
    return scenes.best_cameras(objects, cams).select("id", F.col("camera.name").alias("camera"), "camera.pos")


@query("""SELECT CASE WHEN l_linenumber NOT IN (1, 2, 3) THEN 'unknown_or_sign' WHEN l_linestatus <> 'F' THEN 'not_visible' WHEN l_returnflag = 'N' THEN 'no_direction' WHEN NOT l_quantity <= 20 THEN 'too_far'
  WHEN NOT l_discount * 200 >= 10 THEN 'few_points' ELSE 'passed' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def binary_failure_counts(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST", "TYPE_SIGN"])), F.least("l_linenumber", F.lit(4)))
    rules = scenes.binary_rules(kind, F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.col("l_quantity"), F.col("l_discount") * 200)
    return scenes.failure_counts(table(spark, sf_dir, "lineitem"), rules)


@query("""SELECT user_id, event_type, format('{:,}', n * 1000) AS n, format('{:.1f}', round(m, 1)) AS one, format('{:.2f}', round(m, 2)) AS two, format('{:.3f}', round(m, 3)) AS three
FROM (SELECT user_id, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*) / 100 + 1e-9 AS m FROM events GROUP BY ALL)""")
def number_formats(spark, sf_dir):
    """Counts and means as reports write them."""
    # of whole cents, so that the sum has no order
    mean = F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.count("*") / 100 + 1e-9
    each = [decimals(F.round(mean, k), k).alias(n) for k, n in ((1, "one"), (2, "two"), (3, "three"))]
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(grouped(F.count("*") * 1000).alias("n"), *each)
