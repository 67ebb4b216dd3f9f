"""From frames to relations, and the operators on observed objects: lists, tables, best views, first failing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera
from ..functions import geometry as g
from ..schema import MAX_DISTANCE, MIN_LIDAR


def cameras(frames: DataFrame) -> DataFrame:
    """A row for each camera of each frame, with its position."""
    return frames.select("scene_id", "timestamp", F.posexplode("images").alias("pos", "c")).select("scene_id", "timestamp", "pos", "c.*")


def fan_out(frames: DataFrame) -> dict[str, DataFrame]:
    """The relations of nested frames (rows of ``schema.FRAMES``): scenes (with their sorted timestamps), frames without their lists,
    cameras, point clouds and references of objects.  Each is one projection or aggregation of the scan."""
    each = lambda c: frames.select("scene_id", "timestamp", F.posexplode(c).alias("pos", "c")).select("scene_id", "timestamp", "pos", "c.*")
    return {
        "scenes": frames.groupBy("scene_id").agg(F.array_sort(F.collect_set("timestamp")).alias("timestamps")),
        "frames": frames.drop("images", "point_clouds", "objects"),
        "cameras": each("images"),
        "point_clouds": each("point_clouds"),
        "objects": each("objects"),
    }


def frame_objects(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """The observations that each frame lists (``objects``: an array of structs with id), in its order as ``pos``; one equi-join by frame
    and id.  References without an observation are left out, observations that no frame lists, too."""
    listed_ids = frames.select("scene_id", "timestamp", F.posexplode("objects").alias("pos", "o")).select("scene_id", "timestamp", "pos", F.col("o.id").alias("id"))
    return listed_ids.join(objects, ["scene_id", "timestamp", "id"])


def best_cameras(objects: DataFrame, cams: DataFrame) -> DataFrame:
    """objects with ``camera``: all of the camera of their frame that sees them best, by its name; of cameras of one name the first.  Objects
    whose camera isn't there are left out.  Cameras are reduced to one of a name before they meet the objects."""
    rest = [c for c in cams.columns if c not in ("scene_id", "timestamp", "name")]
    one = cams.groupBy("scene_id", "timestamp", "name").agg(F.min_by(F.struct("name", *rest), "pos").alias("camera"))
    return objects.join(one.withColumnRenamed("name", "most_visible_camera_name"), ["scene_id", "timestamp", "most_visible_camera_name"])


def labelled(objects: DataFrame, labels: DataFrame, colors: DataFrame) -> DataFrame:
    """Objects with cvat_label, cvat_color and in_cvat from two dictionaries (object_id, value).

    Left joins without a hint: the planner broadcasts a dictionary where its size allows it."""
    base = objects.drop("cvat_label", "cvat_color", "in_cvat")
    named = base.join(labels.select(F.col("object_id").alias("id"), F.col("value").alias("cvat_label")), "id", "left")
    return named.join(colors.select(F.col("object_id").alias("id"), F.col("value").alias("cvat_color")), "id", "left").withColumn("in_cvat", F.col("cvat_label").isNotNull())


def in_view(objects: DataFrame) -> DataFrame:
    """Objects that some camera sees best; those of id lists are taken before this."""
    return objects.where(F.coalesce(F.col("most_visible_camera_name"), F.lit("")) != "")


def scene_objects(rows: DataFrame, scene: str, key: str, time: list[str], first: list[str]) -> DataFrame:
    """One row for each object of a scene: the attributes of its first frame and its sorted frames.

    Partial aggregation: a scene's rows meet as one buffer for each object."""
    order = F.struct(*time)
    return rows.groupBy(scene, key).agg(
        *[F.min_by(F.struct(c), order)[c].alias(c) for c in first], F.array_sort(F.collect_set(time[0])).alias("timestamps"), F.count("*").alias("n")
    )


def id_lists(rows: DataFrame, scene: str, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Sorted distinct ids of a scene under each condition, as one array column each."""
    return rows.groupBy(scene).agg(*[F.array_sort(F.collect_set(F.when(c, F.col(key)))).alias(name) for name, c in conditions.items()])


def last_attributes(rows: DataFrame, keys: list[str], order: list[str], attributes: list[str]) -> DataFrame:
    """The attributes of the last row of each key, null ones too."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*attributes), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that isn't met (a null counts as not met); null if all are."""
    out = None
    for name, ok in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def failure_counts(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return rows.groupBy(F.coalesce(first_failure(rules), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def best_view_rules(kind: Column, camera: Column, distance: Column, lidar: Column, camera_there: Column, visibility: Column) -> list[tuple[str, Column]]:
    return [
        ("no_camera_name", F.coalesce(camera, F.lit("")) != ""),
        ("unknown_or_sign", kind.isin("TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST")),
        ("too_far", distance <= MAX_DISTANCE),
        ("few_points", lidar >= MIN_LIDAR),
        ("no_camera", camera_there),
        ("not_visible", visibility > 0),
    ]


def binary_rules(kind: Column, visible: Column, direction: Column, distance: Column, lidar: Column) -> list[tuple[str, Column]]:
    known = kind.isin("TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST")
    return [("unknown_or_sign", known), ("not_visible", visible), ("no_direction", direction.isNotNull()), ("no_type", kind.isNotNull()), ("too_far", distance <= MAX_DISTANCE), ("few_points", lidar >= MIN_LIDAR)]


def best_views(rows: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of each object with the highest positive score, the earliest on ties."""
    from .sequence import best_frame

    return best_frame(rows.where(F.col(score) > 0), keys, F.col(score), ties)


def first_visible(rows: DataFrame, keys: list[str], position: str, seen: Column) -> DataFrame:
    """The first camera, by position, that sees each object.  Aggregates before it shuffles."""
    return rows.where(seen).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), position).alias("_c")).select(*keys, "_c.*")


def co_visible(frames: DataFrame, objects: DataFrame, keys: list[str], key: str, distance: Column, lidar: Column, camera: Column) -> DataFrame:
    """Sorted objects of each frame that are near, well measured and seen; frames without any have an empty list."""
    near = objects.where((lidar >= MIN_LIDAR) & (distance <= MAX_DISTANCE) & camera.isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(key)).alias("visible"))
    return frames.select(*keys).distinct().join(near, keys, "left").withColumn("visible", F.coalesce("visible", F.array().cast(dict(near.dtypes)["visible"])))


def projected(objects: DataFrame, cams: DataFrame) -> DataFrame:
    """scene_id, timestamp, id, camera, pos, width, height and points (u, v, depth, ok of the box's 8 corners).

    Lens distortion where the intrinsic has coefficients; rolling shutter where the camera has a direction of reading, a velocity
    and its times (a line is exposed half the shutter after it opens), else all lines at the time of the pose.  Objects and
    cameras of a frame meet by an equi-join; the rest is one expression of built-in functions for each corner.
    A table of projections from another source can stand in for this one."""
    box = g.centre_box(F.col("camera_synced_box"), F.col("box"))
    o = objects.select("scene_id", "timestamp", "id", box.alias("b"))
    v = F.struct(*[F.coalesce(F.col(f"velocity.v_{a}"), F.lit(0.0)).alias(a) for a in "xyz"])
    w = F.struct(*[F.coalesce(F.col(f"velocity.w_{a}"), F.lit(0.0)).alias(a) for a in "xyz"])
    times = {"first": F.col("camera_trigger_time") + F.col("shutter") / 2 - F.col("pose_timestamp"), "readout": F.col("camera_readout_done_time") - F.col("camera_trigger_time") - F.col("shutter")}
    direction = F.when(F.col("velocity").isNotNull() & F.col("pose").isNotNull(), F.col("metadata.rolling_shutter_direction"))
    still = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])
    c = cams.select(
        "scene_id", "timestamp", F.col("name").alias("camera"), "pos", "intrinsic", "extrinsic", F.col("metadata.width").alias("width"), F.col("metadata.height").alias("height"),
        direction.alias("direction"), F.when(F.col("pose").isNotNull(), camera.in_vehicle(F.col("pose"), v)).otherwise(still).alias("v"), w.alias("w"), *[x.alias(n) for n, x in times.items()],
    )
    joined = o.join(c, ["scene_id", "timestamp"])
    eight = g.corners(*[F.col(f"b.{k}") for k in ("center_x", "center_y", "center_z", "length", "width", "height", "heading")])
    seen = lambda p: camera.rolling_shutter(p, *[F.col(k) for k in ("v", "w", "extrinsic", "intrinsic", "width", "height", "direction", "first", "readout")])
    return joined.select("scene_id", "timestamp", "id", "camera", "pos", "width", "height", F.transform(eight, seen).alias("points"))


def in_images(projections: DataFrame, objects: DataFrame) -> DataFrame:
    """A row for each object and camera of ``projected``: its box in the image [x1, y1, x2, y2], whether all of it is seen, and the
    visibility score, which weighs the box's area by the LiDAR points in the object."""
    b = g.bbox(F.col("points"), F.col("width"), F.col("height"))
    boxed = projections.join(objects.select("scene_id", "timestamp", "id", F.col("num_lidar_points_in_box").alias("lidar")), ["scene_id", "timestamp", "id"]).withColumn("bbox", b)
    score = g.visibility(F.size(F.filter("points", lambda x: x["ok"])), F.exists("points", lambda x: x["depth"] < 0), F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1], F.col("lidar"))
    return boxed.select("scene_id", "timestamp", "id", "camera", "pos", "bbox", g.visible(F.col("points"), F.col("width"), F.col("height")).alias("seen"), score.alias("visibility"))


def most_visible(views: DataFrame) -> DataFrame:
    """The camera of each object and frame with the highest positive visibility, the first by position on ties."""
    return best_views(views, ["scene_id", "timestamp", "id"], "visibility", ["pos"])


def ranked_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def lookup(rows: DataFrame, order: list[str], **values: object) -> DataFrame:
    """The first row, by ``order``, whose columns have the values: an object by id, a frame by timestamp."""
    condition = F.lit(True)
    for name, v in values.items():
        condition = condition & (F.col(name) == F.lit(v))
    return rows.where(condition).orderBy(*order).limit(1)


def mean_speed(rows: DataFrame, keys: list[str], time: str, position: tuple[str, str], seconds: float) -> DataFrame:
    """Distance of the first and last position by the number of frames and the time of one."""
    x, y = position
    ends = rows.groupBy(*keys).agg(F.min_by(F.struct(x, y), time).alias("a"), F.max_by(F.struct(x, y), time).alias("b"), F.count("*").alias("n"))
    d = F.sqrt(F.pow(F.col(f"b.{x}") - F.col(f"a.{x}"), 2) + F.pow(F.col(f"b.{y}") - F.col(f"a.{y}"), 2))
    return ends.select(*keys, (d / (F.col("n") * seconds)).alias("mean_speed"))
