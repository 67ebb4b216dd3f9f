"""Queries on vectors, poses, boxes and detections.  An embedding stands in for a pose (1-16), velocity (17-19), centre (20-22), heading
(23) and size (24-26); a line item for a detected box, its order for the image, and line 1 for the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera
from ..functions import geometry as g
from ..operators import detection, scenes
from ..sources.tables import table
from .registry import query

E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))
    matrix = F.array(*[F.array(*[F.col("v")[4 * r + c] for c in range(4)]) for r in range(4)])
    return out.withColumns({"m": matrix, "cx": F.col("v")[19], "cy": F.col("v")[20], "cz": F.col("v")[21]})


def r6(**columns):
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


C = ("v[20]", "v[21]", "v[22]")


@query(f"{E} SELECT vec_id, {', '.join(f'round(v[{4 * r + 1}] * v[20] + v[{4 * r + 2}] * v[21] + v[{4 * r + 3}] * v[22] + v[{4 * r + 4}], 6) AS {n}' for r, n in enumerate('xyz'))} FROM e")
def pose_transform(spark, sf_dir):
    e = vectors(spark, sf_dir)
    x, y, z = g.transform_point(F.col("m"), F.col("cx"), F.col("cy"), F.col("cz"))
    return e.select("vec_id", *r6(x=x, y=y, z=z))


def _rot(c: int, p=C) -> str:
    return f"{p[0]} * v[{c + 1}] + {p[1]} * v[{c + 5}] + {p[2]} * v[{c + 9}] + v[{c + 13}]"


@query(f"{E} SELECT vec_id, {', '.join(f'round({_rot(c)}, 6) AS {n}' for c, n in enumerate('xyz'))} FROM e")
def camera_rotation(spark, sf_dir):
    e = vectors(spark, sf_dir)
    x, y, z = g.rotate_to_camera(F.col("m"), F.col("cx"), F.col("cy"), F.col("cz"))
    return e.select("vec_id", *r6(x=x, y=y, z=z))


FACING = "CASE WHEN abs({x}) >= abs({y}) THEN CASE WHEN {x} > 0 THEN 'away' ELSE 'towards' END ELSE CASE WHEN {y} > 0 THEN 'left' ELSE 'right' END END"


@query(f"{E}, d AS (SELECT vec_id, v, cos(v[23]) * v[24] / 2 AS hx, sin(v[23]) * v[24] / 2 AS hy FROM e), f AS (SELECT vec_id, round(hx * v[1] + hy * v[5], 9) AS x, round(hx * v[2] + hy * v[6], 9) AS y FROM d) SELECT vec_id, {FACING.format(x='x', y='y')} AS heading FROM f")
def heading_class(spark, sf_dir):
    e = vectors(spark, sf_dir)
    hx, hy, _ = g.heading_vector(F.col("v")[22], F.col("v")[23])
    x, y = (hx * F.col("m")[0][c] + hy * F.col("m")[1][c] for c in (0, 1))
    return e.select("vec_id", g.facing(F.round(x, 9), F.round(y, 9)).alias("heading"))


@query(f"{E}, d AS (SELECT vec_id, sqrt(v[17] * v[17] + v[18] * v[18]) * 20 > 2.8 AS moving, round(v[17] * v[1] + v[18] * v[5] + v[19] * v[9], 9) AS x, round(v[17] * v[2] + v[18] * v[6] + v[19] * v[10], 9) AS y FROM e) SELECT vec_id, CASE WHEN moving THEN {FACING.format(x='x', y='y')} ELSE 'not moving' END AS movement FROM d")
def movement_class(spark, sf_dir):
    e = vectors(spark, sf_dir)
    s = [F.col("v")[i] for i in (16, 17, 18)]
    x, y = (sum((s[r] * F.col("m")[r][c] for r in (1, 2)), s[0] * F.col("m")[0][c]) for c in (0, 1))
    moving = g.is_moving(F.lit("TYPE_VEHICLE"), g.speed(s[0], s[1]) * 20)
    return e.select("vec_id", g.movement(moving, F.round(x, 9), F.round(y, 9)).alias("movement"))


@query(f"{E}, a AS (SELECT vec_id, round(degrees(atan2(v[20], v[21])), 9) AS a FROM e) SELECT vec_id, CASE WHEN a BETWEEN -45 AND 45 THEN 'front' WHEN a > 45 AND a <= 135 THEN 'left' WHEN a >= -135 AND a < -45 THEN 'right' ELSE 'behind' END AS sector FROM a")
def ego_sector(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", g.sector(F.col("cx"), F.col("cy")).alias("sector"))


@query(f"{E} SELECT vec_id, round(sqrt(v[17] * v[17] + v[18] * v[18]), 6) AS speed, round(sqrt(v[20] * v[20] + v[21] * v[21] + v[22] * v[22]), 6) AS distance FROM e")
def speed_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *r6(speed=g.speed(F.col("v")[16], F.col("v")[17]), distance=g.norm(F.col("cx"), F.col("cy"), F.col("cz"))))


POINTS = f"""{E}, p AS (SELECT vec_id, unnest(range(8)) AS i, v FROM e), q AS (SELECT vec_id, 500 + 900 * v[i * 4 + 1] AS u, 400 + 900 * v[i * 4 + 2] AS w, v[i * 4 + 3] + 0.15 AS depth, v[i * 4 + 4] > -0.15 AS ok FROM p)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    each = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((500 + 900 * v[i * 4]).alias("u"), (400 + 900 * v[i * 4 + 1]).alias("v"), (v[i * 4 + 2] + 0.15).alias("depth"), (v[i * 4 + 3] > -0.15).alias("ok")))
    return vectors(spark, sf_dir).select("vec_id", each.alias("p"))


BBOX = f"""{POINTS}, b AS (SELECT vec_id, count(*) FILTER (WHERE ok AND depth > 0) AS n, min(u) FILTER (WHERE ok AND depth > 0) AS u0, max(u) FILTER (WHERE ok AND depth > 0) AS u1, min(w) FILTER (WHERE ok AND depth > 0) AS w0, max(w) FILTER (WHERE ok AND depth > 0) AS w1,
  count(*) FILTER (WHERE ok) AS n_ok, bool_or(depth < 0) AS behind, bool_and(ok AND depth > 0 AND u BETWEEN 0 AND 1000 AND w BETWEEN 0 AND 800) AS seen FROM q GROUP BY vec_id),
c AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(CAST(trunc(u0) AS INTEGER), 1000)) END AS x1, CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(CAST(trunc(w0) AS INTEGER), 800)) END AS y1,
  CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(CAST(trunc(u1) AS INTEGER), 1000)) END AS x2, CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(CAST(trunc(w1) AS INTEGER), 800)) END AS y2 FROM b)"""


def boxed(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("b", g.bbox(F.col("p"), F.lit(1000), F.lit(800)))
    return p.withColumns({n: F.col("b")[i] for i, n in enumerate(("x1", "y1", "x2", "y2"))})


@query(f"{BBOX} SELECT vec_id, x1, y1, x2, y2 FROM c")
def bbox_from_corners(spark, sf_dir):
    return boxed(spark, sf_dir).select("vec_id", "x1", "y1", "x2", "y2")


@query(f"{BBOX} SELECT vec_id, seen, CASE WHEN n_ok < 6 OR behind OR x2 - x1 < 32 OR y2 - y1 < 32 THEN 0.0 ELSE CAST((x2 - x1) * (y2 - y1) * 12 AS DOUBLE) END AS visibility FROM c")
def visibility_score(spark, sf_dir):
    ok = F.size(F.filter("p", lambda x: x["ok"]))
    score = g.visibility(ok, F.exists("p", lambda x: x["depth"] < 0), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(12))
    return boxed(spark, sf_dir).select("vec_id", g.visible(F.col("p"), F.lit(1000), F.lit(800)).alias("seen"), score.alias("visibility"))


@query(f"{BBOX}, m AS (SELECT vec_id, (x1 + x2) / 2 AS u, (y1 + y2) / 2 AS w FROM c) SELECT vec_id, CASE WHEN w < 800 / 3 THEN 'top' WHEN w < 1600 / 3 THEN 'middle' ELSE 'bottom' END || '-' || CASE WHEN u < 1000 / 3 THEN 'left' WHEN u < 2000 / 3 THEN 'center' ELSE 'right' END AS region FROM m")
def image_thirds(spark, sf_dir):
    return boxed(spark, sf_dir).select("vec_id", g.thirds((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.lit(1000), F.lit(800)).alias("region"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'red ' || lower(p_type) WHEN p_size % 3 = 0 THEN lower(p_type) WHEN p_size % 3 = 1 THEN 'Vehicle' ELSE 'object' END AS description FROM part")
def object_description(spark, sf_dir):
    k = F.col("p_size")
    text = g.description(F.when(k % 2 == 0, "red"), F.when(k % 3 == 0, F.col("p_type")), F.when(k % 3 == 1, "TYPE_VEHICLE"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("description"))


# detections: a box id for each line item, by all its columns
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
BOXES = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS box_id FROM lineitem),
boxes AS (SELECT l_orderkey AS image, box_id, l_linenumber = 1 AS truth, l_extendedprice AS score, l_quantity AS x1, l_tax * 100 AS y1, l_quantity + 10 + l_discount * 100 AS x2, l_tax * 100 + 12 AS y2 FROM l),
t AS (SELECT * FROM boxes WHERE truth), f AS (SELECT * FROM boxes WHERE NOT truth),
o AS (SELECT f.image, t.box_id AS truth_id, f.box_id AS found_id, f.score, greatest(0.0, least(f.x2, t.x2) - greatest(f.x1, t.x1)) * greatest(0.0, least(f.y2, t.y2) - greatest(f.y1, t.y1)) AS i,
  (f.x2 - f.x1) * (f.y2 - f.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS a FROM t JOIN f ON t.image = f.image),
iou AS (SELECT image, truth_id, found_id, score, i / (a - i) AS iou FROM o)"""


def all_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("box_id", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long")).select(
        F.col("l_orderkey").alias("image"), "box_id", (F.col("l_linenumber") == 1).alias("truth"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("x1"),
        (F.col("l_tax") * 100).alias("y1"), (F.col("l_quantity") + 10 + F.col("l_discount") * 100).alias("x2"), (F.col("l_tax") * 100 + 12).alias("y2"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = all_boxes(spark, sf_dir)
    return b.where("truth"), b.where("not truth")


@query(f"{BOXES} SELECT image, truth_id, found_id, round(iou, 6) AS iou FROM iou")
def iou_pairs(spark, sf_dir):
    return detection.overlaps(*boxes(spark, sf_dir)).select("image", "truth_id", "found_id", F.round("iou", 6).alias("iou"))


HIT = f"{BOXES}, best AS (SELECT image, found_id, max(iou) AS iou FROM iou GROUP BY ALL), h AS (SELECT f.image, f.box_id, f.score, coalesce(round(iou, 9) >= 0.3, false) AS hit FROM f LEFT JOIN best ON f.image = best.image AND f.box_id = found_id)"


@query(f"{HIT}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS r FROM h), g AS (SELECT image, min(r) FILTER (WHERE hit) AS first FROM r GROUP BY image) SELECT CAST(k AS INTEGER) AS k, count(*) AS images, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS rate FROM g, (SELECT unnest([1, 3, 5]) AS k) GROUP BY k")
def topk_hit_rate(spark, sf_dir):
    h = detection.hits(*boxes(spark, sf_dir), 0.3)
    return detection.top_k_rate(h, [1, 3, 5], "image", [F.col("score").desc(), F.col("box_id")]).withColumn("rate", F.round("rate", 6))


CURVE = f"""{HIT}, b AS (SELECT *, image % 100 AS prompt FROM h), n AS (SELECT image % 100 AS prompt, count(*) AS positives FROM t GROUP BY ALL),
c AS (SELECT prompt, image, box_id, score, hit, CAST(count(*) FILTER (WHERE hit) OVER w AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT hit) OVER w AS BIGINT) AS fp FROM b WINDOW w AS (PARTITION BY prompt ORDER BY score DESC, image, box_id)),
p AS (SELECT c.*, tp / (tp + fp) AS precision, tp / positives AS recall FROM c JOIN n ON c.prompt = n.prompt),
v AS (SELECT *, max(precision) OVER (PARTITION BY prompt ORDER BY score DESC, image, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM p)"""


def curve(spark, sf_dir):
    truth, found = boxes(spark, sf_dir)
    n = truth.groupBy((F.col("image") % 100).alias("prompt")).agg(F.count("*").alias("positives"))
    h = detection.hits(truth, found, 0.3).withColumn("prompt", F.col("image") % 100).join(n, "prompt")
    return detection.precision_recall(h, F.col("positives"), ["prompt"], "hit", [F.col("score").desc(), F.col("image"), F.col("box_id")])


@query(f"{CURVE} SELECT prompt, image, box_id, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM v")
def pr_curve(spark, sf_dir):
    c = curve(spark, sf_dir)
    return c.select("prompt", "image", "box_id", "tp", "fp", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "envelope")])


@query(f"{CURVE}, s AS (SELECT prompt, r, coalesce(max(envelope) FILTER (WHERE floor(round(recall * 100, 9)) >= r), 0.0) AS p FROM v, (SELECT unnest(range(101)) AS r) GROUP BY ALL) SELECT prompt, round(sum(p) / 101, 6) AS ap FROM s GROUP BY prompt")
def average_precision(spark, sf_dir):
    return detection.average_precision(curve(spark, sf_dir), ["prompt"]).withColumn("ap", F.round("ap", 6))


GREEDY = f"""WITH RECURSIVE {BOXES[5:]}, opts AS (SELECT image, found_id, list({{'less': -round(iou, 9), 't': truth_id}} ORDER BY -round(iou, 9), truth_id) AS o FROM iou GROUP BY ALL),
s AS (SELECT f.image, f.box_id, f.score, o, row_number() OVER (PARTITION BY f.image ORDER BY f.score DESC, f.box_id) AS r FROM f LEFT JOIN opts ON f.image = opts.image AND f.box_id = found_id),
th AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in detection.THRESHOLDS)}]) AS threshold),
walk AS (SELECT image, threshold, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT image FROM s), th
  UNION ALL SELECT image, threshold, r, CASE WHEN len(c) > 0 THEN list_append(taken, c[1].t) ELSE taken END, CASE WHEN len(c) > 0 THEN c[1].t END FROM (
    SELECT w.image, w.threshold, s.r, w.taken, list_filter(coalesce(s.o, []), lambda x: -x.less >= w.threshold AND NOT list_contains(w.taken, x.t)) AS c FROM walk w JOIN s ON s.image = w.image AND s.r = w.r + 1)),
m AS (SELECT w.image, w.image % 10 AS prompt, w.threshold, s.box_id, s.score, w.hit IS NOT NULL AS matched FROM walk w JOIN s ON s.image = w.image AND s.r = w.r),
n AS (SELECT image % 10 AS prompt, count(*) AS positives FROM t GROUP BY ALL),
c AS (SELECT *, count(*) FILTER (WHERE matched) OVER w AS tp, count(*) OVER w AS both_ FROM m WINDOW w AS (PARTITION BY prompt, threshold ORDER BY score DESC, image, box_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT c.prompt, threshold, tp / positives AS recall, max(tp / both_) OVER (PARTITION BY c.prompt, threshold ORDER BY score DESC, image, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM c JOIN n ON c.prompt = n.prompt),
g AS (SELECT prompt, threshold, r, coalesce(max(envelope) FILTER (WHERE floor(round(recall * 100, 9)) >= r), 0.0) AS p FROM v, (SELECT unnest(range(101)) AS r) GROUP BY ALL),
ap AS (SELECT prompt, threshold, sum(p) / 101 AS ap FROM g GROUP BY ALL)"""


def _greedy_average(spark, sf_dir):
    b, prompt = all_boxes(spark, sf_dir), (F.col("image") % 10).alias("prompt")
    found = b.where("not truth").select("image", "score", prompt)
    n = b.where("truth").groupBy(prompt).agg(F.count("*").alias("positives"))
    m = detection.greedy_levels(b, detection.THRESHOLDS).withColumn("prompt", prompt)
    return detection.average_precision_at(found, m, n, ["prompt"], detection.THRESHOLDS)


@query(f"{GREEDY} SELECT prompt, round(avg(ap), 6) AS mean_ap FROM ap GROUP BY prompt")
def mean_average_precision(spark, sf_dir):
    """Greedy matching at ten thresholds, AP at each, by prompt."""
    return _greedy_average(spark, sf_dir).groupBy("prompt").agg(F.round(F.avg("ap"), 6).alias("mean_ap"))


@query(f"{GREEDY} SELECT threshold, round(avg(ap), 6) AS mean_ap, count(*) FILTER (WHERE ap > 0) AS prompts FROM ap GROUP BY threshold")
def average_precision_by_threshold(spark, sf_dir):
    """Mean over prompts at each threshold, and how many prompts found anything."""
    return _greedy_average(spark, sf_dir).groupBy("threshold").agg(F.round(F.avg("ap"), 6).alias("mean_ap"), F.count_if(F.col("ap") > 0).alias("prompts"))


NMS = f"""WITH RECURSIVE {BOXES[5:]}, s AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS r FROM boxes),
pairs AS (SELECT a.image, a.r AS r1, b.r AS r2, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS ar FROM s a JOIN s b ON a.image = b.image AND a.r < b.r),
over_ AS (SELECT image, r2, list(r1) AS by_ FROM pairs WHERE round(i / (ar - i), 9) > 0.5 GROUP BY image, r2),
walk AS (SELECT image, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image FROM s)
  UNION ALL SELECT walk.image, s.r, CASE WHEN over_.by_ IS NOT NULL AND list_has_any(walk.kept, over_.by_) THEN walk.kept ELSE list_append(walk.kept, s.r) END FROM walk JOIN s ON s.image = walk.image AND s.r = walk.r + 1 LEFT JOIN over_ ON over_.image = s.image AND over_.r2 = s.r),
final AS (SELECT image, arg_max(kept, r) AS kept FROM walk GROUP BY image)
SELECT s.image, s.box_id, s.score FROM s JOIN final ON s.image = final.image WHERE list_contains(kept, s.r)"""


@query(NMS)
def nms(spark, sf_dir):
    truth, found = boxes(spark, sf_dir)
    return detection.suppressed(truth.unionByName(found), "image", 0.5).select("image", "box_id", "score")


@query(f"{BOXES} SELECT image, box_id, score FROM (SELECT *, min(score) OVER (PARTITION BY image) AS m FROM f) WHERE score >= greatest(50000.0, m)")
def confidence_filter(spark, sf_dir):
    return detection.confident(boxes(spark, sf_dir)[1], "image", 50000.0).select("image", "box_id", "score")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(greatest(0.0, least(l_discount * 8 * 640, 480.0)), 6) AS x FROM lineitem")
def coordinate_rescale_clip(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(g.rescale(F.col("l_discount") * 8, F.lit(640), F.lit(480.0)), 6).alias("x"))


@query(f"{E} SELECT a.vec_id AS box, b.vec_id AS prompt, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 6) AS similarity FROM e a JOIN e b ON a.label = b.label WHERE b.vec_id % 20 = 0")
def embedding_prompt_similarity(spark, sf_dir):
    """Every vector against the prompts of its label; prompts are the vectors whose id is divisible by 20."""
    e = vectors(spark, sf_dir)
    prompts = e.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("prompt"), F.col("v").alias("b"))
    out = detection.similarity(e.select("label", F.col("vec_id").alias("box"), F.col("v").alias("a")), prompts, ["label"], "a", "b")
    return out.select("box", "prompt", F.round("similarity", 6).alias("similarity"))


@query("SELECT user_id AS scene_id, count(*) AS n FROM events WHERE value > 10 GROUP BY user_id")
def objects_in_view(spark, sf_dir):
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), F.when(F.col("value") > 10, "FRONT").alias("most_visible_camera_name"))
    return scenes.in_view(o).groupBy("scene_id").agg(F.count("*").alias("n"))


@query(f"{E}, p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa, list_sum(list_transform(b, lambda x: x * x)) AS bb FROM p) SELECT vec_id, round(CASE WHEN aa * bb = 0 THEN 0.0 ELSE ab / (sqrt(aa) * sqrt(bb)) END, 6) AS cosine FROM d")
def embedding_cosine(spark, sf_dir):
    """Cosine of each vector with the one of the next id."""
    e = vectors(spark, sf_dir).select("vec_id", "v")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(g.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


# A vector stands in for a point ahead, a vehicle's motion, a camera's place and a lens; its id for the direction in which lines are read.
BASE = "vec_id, x, y, z, vx, vy, vz, wx, wy, wz, r, yaw, fu, k1, k2, p1, p2, k3, direction, first, readout"


def _look(n: int, before: str, dt: str, kept: str) -> str:
    """One look at the pixel at time ``dt`` after the pose, and the time t at which that pixel's line is exposed.  In steps that are
    written out, as values that build on each other would else be copied into each other."""
    steps = [
        f"SELECT {BASE}{kept}, {dt} AS dt{n} FROM {before}",
        f"SELECT *, x - vx * dt{n} AS a, y - vy * dt{n} AS b, z - vz * dt{n} AS c, r * dt{n} AS g FROM look{n}_0",
        f"SELECT *, sin(g) / r AS s, (1 - cos(g)) / (r * r) * (wx * a + wy * b + wz * c) AS l FROM look{n}_1",
        f"SELECT *, a * cos(g) - (wy * c - wz * b) * s + wx * l - 1.5 AS dx, b * cos(g) - (wz * a - wx * c) * s + wy * l - 0.1 AS dy, c * cos(g) - (wx * b - wy * a) * s + wz * l - 2.0 AS up FROM look{n}_2",
        f"SELECT *, dx * cos(yaw) + dy * sin(yaw) AS depth, dy * cos(yaw) - dx * sin(yaw) AS side FROM look{n}_3",
        f"SELECT *, CASE WHEN depth > 1e-6 THEN -side / depth END AS p, CASE WHEN depth > 1e-6 THEN -up / depth END AS q FROM look{n}_4",
        f"SELECT *, p * p + q * q AS rr FROM look{n}_5",
        f"SELECT *, 1 + k1 * rr + k2 * rr * rr + k3 * rr * rr * rr AS radial, sqrt((960.0 * 960 + 640 * 640) / rr) AS far FROM look{n}_6",
        f"""SELECT *, coalesce(radial BETWEEN 0.8 AND 1.2, false) AS ok, 480 + CASE WHEN radial BETWEEN 0.8 AND 1.2 THEN fu * (p * radial + 2 * p1 * p * q + p2 * (rr + 2 * p * p)) ELSE p * far END AS u,
  320 + CASE WHEN radial BETWEEN 0.8 AND 1.2 THEN 900 * (q * radial + p1 * (rr + 2 * q * q) + 2 * p2 * p * q) ELSE q * far END AS v FROM look{n}_7""",
    ]
    line = "CASE direction WHEN 1 THEN v / 640 WHEN 2 THEN u / 960 WHEN 3 THEN 1 - v / 640 WHEN 4 THEN 1 - u / 960 END"
    steps.append(f"SELECT *, coalesce(CASE WHEN {line} IS NOT NULL THEN first + readout * greatest(0, least(1, {line})) END, dt{n}) AS t{n} FROM look{n}_8")
    return ", ".join(f"look{n}_{i} AS MATERIALIZED ({sql})" for i, sql in enumerate(steps))


def _shutter_sql(steps: int) -> str:
    looks = [_look(0, "start", "CASE WHEN direction < 5 THEN first + readout / 2 ELSE 0.0 END", "")]
    for k in range(1, 2 * steps + 1):
        if k % 2:
            looks.append(_look(k, f"look{k - 1}_9", f"CASE WHEN direction < 5 THEN t{k - 1} ELSE 0.0 END", f", dt{k - 1}, t{k - 1}"))
        else:
            a, b, was = f"t{k - 2}", f"t{k - 1}", f"dt{k - 2}"
            dt = f"{b} - coalesce(CASE WHEN {b} - 2 * {a} + {was} <> 0 THEN ({b} - {a}) * ({b} - {a}) / ({b} - 2 * {a} + {was}) END, 0.0)"
            looks.append(_look(k, f"look{k - 1}_9", f"CASE WHEN direction < 5 THEN {dt} ELSE 0.0 END", ""))
    n = 2 * steps
    return f"""{E}, start AS (SELECT vec_id, 14 + 20 * v[20] AS x, 8 * v[21] AS y, 1 + 3 * v[22] AS z, 10 + 20 * v[17] AS vx, 4 * v[18] AS vy, v[19] AS vz, 0.4 * v[30] AS wx, 0.4 * v[31] AS wy, 0.4 * v[32] AS wz,
  0.4 * sqrt(v[30] * v[30] + v[31] * v[31] + v[32] * v[32]) AS r, v[23] AS yaw, 900 + 200 * v[24] AS fu, v[25] / 10 AS k1, v[26] / 20 AS k2, v[27] / 100 AS p1, v[28] / 100 AS p2, v[29] / 100 AS k3, 1 + vec_id % 5 AS direction,
  v[33] / 100 - 0.02 AS first, 0.04 AS readout FROM e), {", ".join(looks)} SELECT vec_id, round(u, 6) AS u, round(v, 6) AS v, round(depth, 6) AS depth, ok FROM look{n}_9"""


@query(_shutter_sql(4))
def rolling_shutter_projection(spark, sf_dir):
    v = lambda i: F.col("v")[i - 1]
    xyz = lambda *c: F.struct(*[x.alias(a) for a, x in zip("xyz", c, strict=True)])
    c, s = F.cos(v(23)), F.sin(v(23))
    zero, one = F.lit(0.0), F.lit(1.0)
    extrinsic = F.array(F.array(c, -s, zero, F.lit(1.5)), F.array(s, c, zero, F.lit(0.1)), F.array(zero, zero, one, F.lit(2.0)))
    lens = F.array(900 + 200 * v(24), F.lit(900.0), F.lit(480.0), F.lit(320.0), v(25) / 10, v(26) / 20, v(27) / 100, v(28) / 100, v(29) / 100)
    e = vectors(spark, sf_dir).select(
        "vec_id", xyz(14 + 20 * v(20), 8 * v(21), 1 + 3 * v(22)).alias("p"), xyz(10 + 20 * v(17), 4 * v(18), v(19)).alias("speed"), xyz(0.4 * v(30), 0.4 * v(31), 0.4 * v(32)).alias("turn"),
        extrinsic.alias("extrinsic"), lens.alias("lens"), (v(33) / 100 - 0.02).alias("first"), (1 + F.col("vec_id") % 5).alias("direction"),
    )
    seen = camera.rolling_shutter(*[F.col(n) for n in ("p", "speed", "turn", "extrinsic", "lens")], F.lit(960), F.lit(640), F.col("direction"), F.col("first"), F.lit(0.04))
    return e.select("vec_id", seen.alias("s")).select("vec_id", *r6(u=F.col("s.u"), v=F.col("s.v"), depth=F.col("s.depth")), "s.ok")


def _minor(rows: list[int], columns: list[int]) -> str:
    """Determinant of the named rows and columns, by its definition."""
    if len(rows) == 1:
        return f"v[{4 * rows[0] + columns[0] + 1}]"
    parts = [f"v[{4 * rows[0] + c + 1}] * ({_minor(rows[1:], columns[:k] + columns[k + 1 :])})" for k, c in enumerate(columns)]
    return parts[0] + "".join((" - " if k % 2 == 0 else " + ") + x for k, x in enumerate(parts[1:]))


FOUR = list(range(4))
COFACTORS = ", ".join(f"{'-' if (r + c) % 2 else ''}({_minor([i for i in FOUR if i != c], [i for i in FOUR if i != r])}) AS c{4 * r + c}" for r in FOUR for c in FOUR)


@query(f"{E}, c AS (SELECT vec_id, {_minor(FOUR, FOUR)} AS det, {COFACTORS} FROM e) SELECT vec_id, {', '.join(f'round(c{i} / det, 3) + 0.0 AS i{i}' for i in range(16))}, CAST(0.0 AS DOUBLE) AS off FROM c")
def matrix_inverse(spark, sf_dir):
    """The inverse of each vector's matrix, and how far their product is from the unit matrix, to nine places."""
    e = vectors(spark, sf_dir).select("vec_id", "m").withColumn("inv", g.inverse(F.col("m")))
    off = F.transform(g.product(F.col("m"), F.col("inv")), lambda r, i: F.array_max(F.transform(r, lambda x, j: F.abs(x - F.when(i == j, 1.0).otherwise(0.0)))))
    return e.select("vec_id", *[(F.round(F.col("inv")[i // 4][i % 4], 3) + 0.0).alias(f"i{i}") for i in range(16)], F.round(F.array_max(off), 9).alias("off"))


@query(f"{E} SELECT vec_id, round(coalesce(CASE WHEN vec_id % 3 > 0 THEN v[17] END, 0.0), 6) AS vx, round(v[18], 6) AS vy, round(v[19], 6) AS vz, round(cos(v[23]) * v[24] / 2, 6) + 0.0 AS hx, round(sin(v[23]) * v[24] / 2, 6) + 0.0 AS hy FROM e")
def motion_vectors(spark, sf_dir):
    """Velocities with zeros for what is missing, and heading vectors of half a box's length."""
    e = vectors(spark, sf_dir)
    vx, vy, vz = g.vector(F.when(F.col("vec_id") % 3 > 0, F.col("v")[16]), F.col("v")[17], F.col("v")[18])
    hx, hy, _ = g.heading_vector(F.col("v")[22], F.col("v")[23])
    return e.select("vec_id", *r6(vx=vx, vy=vy, vz=vz), (F.round(hx, 6) + 0.0).alias("hx"), (F.round(hy, 6) + 0.0).alias("hy"))
