"""Queries on the question builders, on stand-ins: events are frames and observed objects, parts are boxed objects.  Draws are md5
ranks, so SQL repeats every text, choice and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import questions, trajectories
from ..schema import BANDS, ATTRIBUTE_TEXT, CHOICES, COLORS, DAY_PERIODS, DIRECTION_PHRASE, FACING_TEXT, HEADINGS, LABELS, MOVEMENTS, MOVING_TEXT, NIGHT, SCENARIO_TEXT, TRAJECTORY_TEXT, ZONES
from ..sources.tables import cut, table
from .registry import SQL, query
from .scenes import TRACKS, tracks

KINDS = ("TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST")


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return f"[{', '.join(map(text, xs))}]"


def texts_table(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)})"


def drawn(options: str, seed: str, key: str) -> str:
    return f"({options})[CAST('0x' || substr(md5('{seed}|' || {key}), 1, 7) AS BIGINT) % len({options}) + 1]"


def id_of(key: str) -> str:
    return "concat_ws('-', " + ", ".join(f"substr(md5({key}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def options(c: str) -> str:
    return f"CASE WHEN len({c}) > 1 THEN array_to_string({c}[:len({c}) - 1], ', ') || ' or ' || {c}[len({c})] ELSE coalesce({c}[1], '') END"


def band_sql(kind: str, v: str, last: bool = False) -> str:
    inner = lambda each: " ".join(f"WHEN {v} >= {lo} AND {v} <= {min(hi, 1e300)} THEN '{n}'" for n, lo, hi in (reversed(each) if last else each))
    return "CASE " + " ".join(f"WHEN {kind} = '{t}' THEN CASE {inner(each)} ELSE 'stationary' END" for t, each in BANDS.items()) + " ELSE 'stationary' END"


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """df with arrays as comma-joined text."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ") for c in columns})


def binary_part(name: str, column: str) -> str:
    return f"""s_{column} AS (SELECT DISTINCT scene_id, timestamp, camera, type, {column} AS direction, band FROM here),
w_{column} AS (SELECT scene_id, timestamp, camera, count(*) AS wanted FROM s_{column} GROUP BY ALL),
n_{column} AS (SELECT * FROM (SELECT w.*, u.*, row_number() OVER (PARTITION BY scene_id, timestamp, camera ORDER BY md5(concat_ws('|', 'binary{name}', scene_id, timestamp, camera, type, direction, band)), type, direction, band) AS r
  FROM w_{column} w, universe u WHERE NOT EXISTS (SELECT 1 FROM s_{column} s WHERE s.scene_id = w.scene_id AND s.timestamp = w.timestamp AND s.camera = w.camera AND s.type = u.type AND s.direction = u.direction AND s.band = u.band)) WHERE r <= wanted),
p_{column} AS (SELECT b.*, '{name}' AS question_name, replace(t.t, '{{}}', coalesce(phrase, '')) AS question FROM (
  SELECT scene_id, timestamp, camera, type, direction, band, 'yes' AS answer FROM s_{column} UNION ALL SELECT scene_id, timestamp, camera, type, direction, band, 'no' FROM n_{column}) b
  JOIN t_{column} t ON b.type = t.type AND b.band = t.band LEFT JOIN phrases ON b.direction = phrases.direction)"""


BINARY = f"""WITH {texts_table('phrases', 'direction, phrase', [(text(k), text(v)) for k, v in DIRECTION_PHRASE.items()])},
{texts_table('t_direction', 'type, band, t', [(text(a), text(b), text(v)) for (a, b), v in MOVING_TEXT.items()])},
{texts_table('t_facing', 'type, band, t', [(text(a), text(b), text(v)) for (a, b), v in FACING_TEXT.items()])},
{texts_table('universe', 'type, direction, band', [(text(t), text(d), text(b)) for t in KINDS for d in HEADINGS for b, _, _ in BANDS[t]])},
kinds AS (SELECT *, {listed(KINDS)}[event_id % 3 + 1] AS type FROM events),
seen AS (SELECT CAST(user_id AS VARCHAR) AS scene_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, 'FRONT' AS camera, type, {listed(MOVEMENTS)}[event_id % 5 + 1] AS direction, {listed(HEADINGS)}[event_id % 4 + 1] AS facing, {band_sql('type', 'value')} AS band FROM kinds),
chosen AS (SELECT scene_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY md5(concat_ws('|', 'binary', scene_id, timestamp)), timestamp) AS r FROM (SELECT DISTINCT scene_id, timestamp FROM seen)) WHERE r = 1),
here AS (SELECT seen.* FROM seen JOIN chosen USING (scene_id, timestamp)),
{binary_part('_object_movement_direction_type', 'direction')},
{binary_part('_object_facing_type', 'facing')},
both_ AS (SELECT * FROM p_direction UNION ALL SELECT * FROM p_facing)
SELECT *, 'yes, no' AS choices, {id_of("concat_ws('|', scene_id, timestamp, camera, question_name, type, direction, band)")} AS question_id FROM both_"""


@query(BINARY)
def questions_object_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % n + 1).cast("int"))
    kind = pick(KINDS, 3)
    seen = e.select(
        F.col("user_id").cast("string").alias("scene_id"), F.date_trunc("day", "ts").cast("string").alias("timestamp"), F.lit("FRONT").alias("camera"), kind.alias("type"),
        pick(MOVEMENTS, 5).alias("direction"), pick(HEADINGS, 4).alias("facing"), g.speed_band(kind, F.col("value")).alias("band"),
    )
    return joined(questions.get("object_binary")(seen, seen), "choices")


def of_part(xs) -> str:
    return f"{listed(xs)}[p_partkey % {len(xs)} + 1]"


ATTRIBUTES = [
    ("_color_prompt", listed(COLORS), f"CASE WHEN p_partkey % 3 > 0 THEN {of_part(COLORS)} END"),
    ("_label_prompt", listed(LABELS), f"CASE WHEN p_partkey % 4 > 0 THEN {of_part(LABELS)} END"),
    ("_heading_prompt", listed(HEADINGS), of_part(HEADINGS)),
    ("_speed_prompt", listed([b for b, _, _ in BANDS["TYPE_VEHICLE"]]), band_sql("'TYPE_VEHICLE'", "p_size / 2", last=True)),
    ("_movement_direction_prompt", listed(MOVEMENTS), of_part(MOVEMENTS)),
]
RANKED = "list_transform(list_sort(list_transform({a}, lambda c: {{'d': md5('drawn{t}|' || key || '|' || c), 'c': c}})), lambda x: x.c)"
DRAWN_BOX = f"""WITH each AS ({' UNION ALL '.join(f"SELECT p_partkey, '{n}' AS question_name, {c} AS every, {a} AS answer, {listed(ATTRIBUTE_TEXT[n])} AS texts FROM part" for n, c, a in ATTRIBUTES)}),
k AS (SELECT *, CAST(p_partkey % 50 AS VARCHAR) AS scene_id, CAST(p_partkey AS VARCHAR) AS object_id, concat_ws('|', p_partkey % 50, p_partkey, question_name) AS key FROM each WHERE answer IS NOT NULL),
o AS (SELECT *, {RANKED.format(a='list_filter(every, lambda c: c <> answer)', t='d')}[:{CHOICES - 1}] AS others FROM k),
c AS (SELECT *, CASE WHEN len(every) > {CHOICES} THEN {RANKED.format(a='list_append(others, answer)', t='o')} ELSE every END AS c FROM o)
SELECT scene_id, object_id, '0, 0, 0, 0' AS bbox, question_name, answer, array_to_string(c, ', ') AS choices, replace({drawn('texts', 'drawn', 'key')}, '{{}}', {options('c')}) AS question, {id_of('key')} AS question_id
FROM c WHERE len(c) >= 2 AND list_contains(c, answer)"""


@query(DRAWN_BOX)
def questions_drawn_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    views = table(spark, sf_dir, "part").select(
        (k % 50).cast("string").alias("scene_id"), k.cast("string").alias("object_id"), F.lit("TYPE_VEHICLE").alias("type"), F.when(k % 3 > 0, pick(COLORS)).alias("color"), F.when(k % 4 > 0, pick(LABELS)).alias("label"),
        pick(HEADINGS).alias("heading"), pick(MOVEMENTS).alias("movement"), (F.col("p_size") / 2).alias("speed"), F.array(*[F.lit(0)] * 4).alias("bbox"),
    )
    return joined(questions.get("object_drawn_box")(views), "choices", "bbox")


ASKED = ["faster_than_ego", "moving_towards_ego", "parallel_motion", "approaching_stop_sign", "vehicle_future_path"]
FOUND = " UNION ALL ".join(f"SELECT scene_id, object_id, idx, answer, {'scenario' if n == 'moving_towards_ego' else 'NULL'} AS scenario, '_prompt_{n}' AS question_name FROM ({SQL[n]})" for n in ASKED)
EGO_RELATIVE = f"""WITH {texts_table('texts', 'name, list', [(text(k), listed(v)) for k, v in (SCENARIO_TEXT | TRAJECTORY_TEXT).items()])}, found AS ({FOUND}),
seen AS ({TRACKS} SELECT scene_id, object_id, idx, coalesce(label, kind) AS description FROM t WHERE visible),
k AS (SELECT found.*, description, concat_ws('|', question_name, found.scene_id, found.object_id, found.idx, answer) AS key FROM found JOIN seen ON found.scene_id = seen.scene_id AND found.object_id = seen.object_id AND found.idx = seen.idx),
asked AS (SELECT scene_id, object_id, idx, answer, scenario, question_name, description, '0, 0, 0, 0' AS bbox, CASE WHEN question_name = '_prompt_parallel_motion' THEN 'parallel, perpendicular' ELSE 'yes, no' END AS choices,
  replace({drawn('list', 'ego', 'key')}, '{{}}', description) AS question, {id_of('key')} AS question_id FROM k JOIN texts ON coalesce(scenario, question_name) = name)"""


def ego_relative(spark: SparkSession, sf_dir: str, t: DataFrame) -> DataFrame:
    found = None
    for name in ASKED:
        operator = trajectories.future_path if name == "vehicle_future_path" else getattr(trajectories, name)
        part = operator(t)
        scenario = F.col("scenario") if "scenario" in part.columns else F.lit(None).cast("string")
        part = part.select("scene_id", "object_id", "idx", "answer", scenario.alias("scenario"), F.lit(f"_prompt_{name}").alias("question_name"))
        found = part if found is None else found.unionByName(part)
    seen = t.where("visible").select("scene_id", "object_id", "idx", F.coalesce("label", "kind").alias("description"), F.array(*[F.lit(0)] * 4).alias("bbox"))
    return questions.get("ego_relative")(found, seen)


@query(f"{EGO_RELATIVE} SELECT * FROM asked")
def questions_ego_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ego_relative(spark, sf_dir, cut(tracks(spark, sf_dir))), "choices", "bbox")


SHOWN = """SELECT scene_id, object_id, idx, camera, concat_ws(', ', idx, CASE camera WHEN 'SIDE' THEN 1 ELSE 0 END, idx + 1, 1) AS bbox, concat_ws('/', scene_id, idx || camera || '.jpg') AS image_path, best FROM (
  SELECT *, 'FRONT' AS camera, idx % 2 = 0 AS best FROM shown_at WHERE idx % 7 <> 3 UNION ALL SELECT *, 'SIDE', idx % 2 = 1 FROM shown_at WHERE idx % 5 <> 2)"""


@query(f"""{EGO_RELATIVE}, shown_at AS ({TRACKS} SELECT scene_id, object_id, idx FROM t WHERE observed), shown AS ({SHOWN}),
pairs AS (SELECT *, CASE WHEN idx = 0 THEN 1 ELSE idx END AS current_idx, CASE WHEN idx = 0 THEN 0 ELSE idx - 1 END AS previous_idx FROM asked)
SELECT p.* EXCLUDE (bbox), v.camera AS camera_name, c.bbox AS current_bbox, c.image_path AS current_image_path, v.bbox AS previous_bbox, v.image_path AS previous_image_path FROM pairs p
JOIN shown v ON p.scene_id = v.scene_id AND p.object_id = v.object_id AND p.previous_idx = v.idx AND v.best
JOIN shown c ON p.scene_id = c.scene_id AND p.object_id = c.object_id AND p.current_idx = c.idx AND c.camera = v.camera""")
def questions_ego_relative_two_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions with the frame before, by the camera that saw the object best then.  One of two cameras misses the object in every
    seventh frame, the other in every fifth; they are best in turn."""
    t = cut(tracks(spark, sf_dir))
    idx = F.col("idx")
    cameras = F.explode(F.array(
        F.struct(F.lit("FRONT").alias("camera"), F.lit(0).alias("y"), (idx % 2 == 0).alias("best"), (idx % 7 != 3).alias("shown")), F.struct(F.lit("SIDE").alias("camera"), F.lit(1).alias("y"), (idx % 2 == 1).alias("best"), (idx % 5 != 2).alias("shown")),
    ))
    views = t.where("observed").select("scene_id", "object_id", "idx", cameras.alias("c")).select(
        "scene_id", "object_id", "idx", "c.camera", F.array(idx, F.col("c.y"), idx + 1, F.lit(1)).alias("bbox"), F.concat_ws("/", "scene_id", F.concat(idx.cast("string"), F.col("c.camera"), F.lit(".jpg"))).alias("image_path"),
        F.col("c.shown").alias("visible"), "c.best",
    )
    out = questions.get("ego_relative_multi_frame")(ego_relative(spark, sf_dir, t), views, t.select("scene_id", "idx"))
    return joined(out, "choices", "current_bbox", "previous_bbox")


PERIOD = "CASE " + " ".join(f"WHEN h >= {lo} AND h < {hi} THEN {text(n)}" for lo, hi, n in DAY_PERIODS) + f" ELSE {text(NIGHT)} END"
SCENE_TEXT = [
    ("weather", "What is the weather in this scene out of {}?", ["sunny", "rain"], "CASE WHEN event_id % 3 > 0 THEN 'sunny' END"),
    ("time_of_day", "What is the time of day in this scene out of {}?", ["Day", "Dawn/Dusk", "Night"], "'Day'"),
    ("location", "Which city is this scene from out of {}?", list(ZONES), "'location_phx'"),
    ("detailed_time", "Which part of the day is it out of {}?", [n for *_, n in DAY_PERIODS] + [NIGHT], PERIOD),
]


@query(f"""WITH h AS (SELECT *, hour(timezone('America/Phoenix', timezone('UTC', ts))) AS h, CAST(user_id AS VARCHAR) AS scene_id, epoch_us(ts) AS timestamp FROM events),
q AS ({' UNION ALL '.join(f"SELECT scene_id, timestamp, '{n}' AS question_name, {listed(c)} AS c, {a} AS answer, {text(t)} AS t FROM h" for n, t, c, a in SCENE_TEXT)})
SELECT scene_id, timestamp, question_name, array_to_string(c, ', ') AS choices, answer, replace(t, '{{}}', {options('c')}) AS question, {id_of("concat_ws('|', scene_id, timestamp, question_name)")} AS question_id FROM q WHERE answer IS NOT NULL""")
def questions_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").cast("string").alias("scene_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(F.col("event_id") % 3 > 0, "sunny").alias("weather"), F.lit("Day").alias("time_of_day"), F.lit("location_phx").alias("location"))
    return joined(questions.get("scene_multi_choice")(frames), "choices")
