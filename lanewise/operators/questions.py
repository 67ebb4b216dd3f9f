"""Question builders: each takes prepared tables and gives rows of one wide question and answer.  A registry finds them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..schema import ATTRIBUTE_TEXT, BANDS, CHOICES, COLORS, DIRECTION_PHRASE, FACING_TEXT, HEADINGS, LABELS, MOVEMENTS, MOVING_TEXT, SCENARIO_TEXT, TRAJECTORY_TEXT, ZONES
from . import sampling

BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def builder(name: str):
    def register(f):
        BUILDERS[name] = f
        return f

    return register


def get(name: str) -> Callable[..., DataFrame]:
    if name not in BUILDERS:
        raise ValueError(f"no question builder {name}; there are {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name]


def literal_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def case(table: dict, *keys: Column) -> Column:
    """Value of a constant table by one or more key columns; null where it has none."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        match = None
        for col, x in zip(keys, k if isinstance(k, tuple) else (k,), strict=True):
            match = (col == x) if match is None else match & (col == x)
        out = F.when(match, F.lit(v)).otherwise(out)
    return out


def question_id(*parts: Column) -> Column:
    """A uuid-shaped md5 of the natural key: the same in every run."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def kept(rows: DataFrame) -> DataFrame:
    """Rows with an answer that is one of two or more choices."""
    return rows.where(F.col("answer").isNotNull() & (F.size("choices") >= 2) & F.array_contains("choices", F.col("answer")))


@builder("object_binary")
def object_binary(observed: DataFrame, frames: DataFrame, seed: str = "binary") -> DataFrame:
    """observed: scene_id, timestamp, camera, type, direction, facing, band of objects that pass the rules.

    One frame of each scene, by md5; for each camera the (type, direction, band) seen give 'yes', and as many not seen 'no'.
    A direction outside the four has text for standing objects only, so it takes no part where its template needs one."""
    chosen = frames.select("scene_id", "timestamp").distinct().groupBy("scene_id").agg(F.min_by("timestamp", F.struct(sampling.draw(seed, "scene_id", "timestamp"), F.col("timestamp"))).alias("timestamp"))
    here = observed.join(chosen, ["scene_id", "timestamp"])
    spark = observed.sparkSession
    universe = spark.createDataFrame([(t, d, b) for t in ("TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST") for d in HEADINGS for b, _, _ in BANDS[t]], "type string, direction string, band string")
    groups, keys = ["scene_id", "timestamp", "camera"], ["type", "direction", "band"]
    out = None
    for name, column, texts in (("_object_movement_direction_type", "direction", MOVING_TEXT), ("_object_facing_type", "facing", FACING_TEXT)):
        seen = here.select(*groups, "type", F.col(column).alias("direction"), "band").distinct()
        no = sampling.negatives(seen, universe, groups, keys, seed + name)
        both = seen.withColumn("answer", F.lit("yes")).unionByName(no.withColumn("answer", F.lit("no")))
        text = tx.filled(case(texts, F.col("type"), F.col("band")), F.coalesce(case(DIRECTION_PHRASE, F.col("direction")), F.lit("")))
        part = both.withColumns({"question_name": F.lit(name), "question": text, "choices": literal_array(["yes", "no"])}).where("question is not null")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("question_id", question_id(*[F.col(c) for c in (*groups, "question_name", *keys)]))


@builder("object_drawn_box")
def object_drawn_box(views: DataFrame, seed: str = "drawn") -> DataFrame:
    """views: one best view of each object: scene_id, object_id, type, color, label, heading, movement, speed, bbox.

    A question for each attribute that is known; more than four choices are cut to the answer and three others."""
    band = g.speed_band(F.col("type"), F.col("speed"), last=True)
    each = [
        ("_color_prompt", literal_array(COLORS), F.col("color")),
        ("_label_prompt", literal_array(LABELS), F.col("label")),
        ("_heading_prompt", literal_array(HEADINGS), F.col("heading")),
        ("_speed_prompt", _bands_of(F.col("type")), band),
        ("_movement_direction_prompt", literal_array(MOVEMENTS), F.col("movement")),
    ]
    rows = views.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("question_name"), c.alias("all"), a.alias("answer"), literal_array(ATTRIBUTE_TEXT[n]).alias("texts")) for n, c, a in each])).alias("q"))
    rows = rows.select("scene_id", "object_id", "bbox", "q.question_name", "q.all", "q.answer", "q.texts").where("answer is not null")
    key = F.concat_ws("|", "scene_id", "object_id", "question_name")
    rows = rows.withColumn("choices", sampling.fewer_choices(F.col("all"), F.col("answer"), CHOICES, seed, key))
    rows = rows.withColumn("question", tx.filled(sampling.pick(F.col("texts"), seed, key), tx.formatted_options(F.col("choices")))).drop("all", "texts")
    return kept(rows).withColumn("question_id", question_id(key))


def _bands_of(kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for t, each in BANDS.items():
        out = F.when(kind == t, literal_array([b for b, _, _ in each])).otherwise(out)
    return out


@builder("ego_relative")
def ego_relative(found: DataFrame, described: DataFrame, seed: str = "ego") -> DataFrame:
    """found: rows of the trajectory questions with question_name, scene_id, object_id, idx, answer, scenario (or null).
    described: scene_id, object_id, idx, description, bbox of objects that their best camera sees whole.

    A text is drawn by md5 from those of the scenario, or of the question where it has none."""
    rows = found.join(described, ["scene_id", "object_id", "idx"])
    key = F.concat_ws("|", "question_name", "scene_id", "object_id", "idx", "answer")
    texts = {**SCENARIO_TEXT, **TRAJECTORY_TEXT}
    by_name = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), literal_array(v))])
    template = sampling.pick(by_name[F.coalesce("scenario", "question_name")], seed, key)
    choices = F.when(F.col("question_name") == "_prompt_parallel_motion", literal_array(["parallel", "perpendicular"])).otherwise(literal_array(["yes", "no"]))
    return kept(rows.withColumns({"choices": choices, "question": tx.filled(template, F.col("description")), "question_id": question_id(key)}))


@builder("ego_relative_multi_frame")
def ego_relative_multi_frame(single: DataFrame, views: DataFrame, frames: DataFrame) -> DataFrame:
    """Questions of ``ego_relative`` shown in two frames; single rows need idx.  frames: scene_id, idx.
    views: scene_id, object_id, idx, camera, bbox, image_path, visible (the camera shows all of the object), best (it is the object's most
    visible camera in that frame).

    Both frames are shown by the camera that sees the object best in the previous one, and both must show the object there."""
    from .sequence import previous_pairs

    pairs = previous_pairs(frames.select("scene_id", "idx").distinct(), ["scene_id"])
    side = lambda v, p: v.where("visible").select("scene_id", "object_id", "camera", F.col("idx").alias(f"{p}_idx"), F.col("bbox").alias(f"{p}_bbox"), F.col("image_path").alias(f"{p}_image_path"))
    asked = single.drop("bbox").join(pairs, ["scene_id", "idx"]).join(side(views.where("best"), "previous"), ["scene_id", "object_id", "previous_idx"])
    return asked.join(side(views, "current"), ["scene_id", "object_id", "camera", "current_idx"]).withColumnRenamed("camera", "camera_name")


@builder("scene_multi_choice")
def scene_multi_choice(frames: DataFrame) -> DataFrame:
    """frames: scene_id, timestamp, weather, time_of_day, location.  A question for each known attribute and for the part of the day."""
    zone = F.coalesce(case(ZONES, F.col("location")), F.lit("America/Los_Angeles"))
    period = tx.day_period(F.col("timestamp"), zone)
    each = [("weather", "What is the weather in this scene out of {}?", ["sunny", "rain"], F.col("weather")), ("time_of_day", "What is the time of day in this scene out of {}?", ["Day", "Dawn/Dusk", "Night"], F.col("time_of_day")), ("location", "Which city is this scene from out of {}?", list(ZONES), F.col("location")), ("detailed_time", "Which part of the day is it out of {}?", [p for *_, p in tx.DAY_PERIODS] + [tx.NIGHT], period)]
    rows = frames.select("scene_id", "timestamp", F.explode(F.array(*[F.struct(F.lit(n).alias("question_name"), F.lit(t).alias("template"), literal_array(c).alias("choices"), a.alias("answer")) for n, t, c, a in each])).alias("q")).select("scene_id", "timestamp", "q.*")
    return kept(rows).withColumns({"question": tx.filled(F.col("template"), tx.formatted_options(F.col("choices"))), "question_id": question_id(F.col("scene_id"), F.col("timestamp"), F.col("question_name"))}).drop("template")


def model_prompt(question: Column, choices: Column, camera: Column, seed: str, key: Column) -> Column:
    """Question, an example choice by md5, the options and the camera to look at."""
    example = sampling.pick(choices, seed, key)
    return F.concat(question, F.lit("\nAnswer with one option, for example: "), example, F.lit("\nOptions: "), tx.formatted_options(choices), F.lit("\nFocus on the "), F.lower(F.replace(camera, F.lit("_"), F.lit(" "))), F.lit(" camera."))


def best_image(paths: Column, names: Column, camera: Column) -> Column:
    """The image of the named camera (FRONT if null); the first one if it isn't there."""
    return F.element_at(paths, F.greatest(F.array_position(names, F.coalesce(camera, F.lit("FRONT"))), F.lit(1)).cast("int"))


def conversation(sample_id: Column, image: Column, question: Column, choices: Column, answer: Column) -> Column:
    """A sample as a conversation for fine-tuning, as JSON."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    ask = F.concat(F.lit("<image>\n"), question, F.lit("\nOptions: "), tx.formatted_options(choices))
    return F.to_json(F.struct(sample_id.alias("id"), F.regexp_extract(image, r"([^/]+)$", 1).alias("image"), F.array(turn("human", ask), turn("gpt", answer)).alias("conversations")))
