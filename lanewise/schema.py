"""Tables of the data model as DDL, and the constant dimensions as plain Python and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INF = float("inf")

BOX = "STRUCT<center_x: DOUBLE, center_y: DOUBLE, center_z: DOUBLE, length: DOUBLE, width: DOUBLE, height: DOUBLE, heading: DOUBLE>"
MATRIX = "ARRAY<ARRAY<DOUBLE>>"
CALIBRATION = f"STRUCT<name: STRING, intrinsic: ARRAY<DOUBLE>, extrinsic: {MATRIX}, width: INT, height: INT, rolling_shutter_direction: INT>"
LASER = f"STRUCT<name: STRING, beam_inclinations: ARRAY<DOUBLE>, extrinsic: {MATRIX}>"
VELOCITY = "STRUCT<v_x: DOUBLE, v_y: DOUBLE, v_z: DOUBLE, w_x: DOUBLE, w_y: DOUBLE, w_z: DOUBLE>"
CAMERA = (
    f"STRUCT<name: STRING, path: STRING, velocity: {VELOCITY}, intrinsic: ARRAY<DOUBLE>, extrinsic: {MATRIX}, "
    f"metadata: STRUCT<width: INT, height: INT, rolling_shutter_direction: INT>, pose: {MATRIX}, "
    "pose_timestamp: DOUBLE, shutter: DOUBLE, camera_trigger_time: DOUBLE, camera_readout_done_time: DOUBLE>"
)

SCENES = (f"scene_id STRING, tfrecord_name STRING, camera_calibrations ARRAY<{CALIBRATION}>, laser_calibrations ARRAY<{LASER}>")
FRAMES = (
    f"scene_id STRING, timestamp BIGINT, pose {MATRIX}, time_of_day STRING, weather STRING, location STRING, images ARRAY<{CAMERA}>, "
    f"point_clouds ARRAY<{LASER}>, objects ARRAY<STRUCT<id: STRING, path: STRING>>"
)
OBJECTS = (
    "id STRING, scene_id STRING, timestamp BIGINT, in_cvat BOOLEAN, cvat_label STRING, cvat_color STRING, visible_cameras ARRAY<STRING>, "
    f"frames ARRAY<BIGINT>, box {BOX}, camera_synced_box {BOX}, type STRING, detection_difficulty_level INT, "
    "tracking_difficulty_level INT, num_lidar_points_in_box INT, num_top_lidar_points_in_box INT, most_visible_camera_name STRING, "
    "metadata STRUCT<speed_x: DOUBLE, speed_y: DOUBLE, speed_z: DOUBLE, accel_x: DOUBLE, accel_y: DOUBLE, accel_z: DOUBLE>"
)
PROJECTIONS = ("scene_id STRING, timestamp BIGINT, object_id STRING, camera STRING, corner INT, u DOUBLE, v DOUBLE, depth DOUBLE, ok BOOLEAN")

#: One wide question and answer instead of a class for each kind: nothing is lost when kinds share a declared type.
QUESTION = (
    "question_type STRING, question_name STRING, question_id STRING, generator_name STRING, question STRING, scene_id STRING, timestamp BIGINT, "
    "object_id STRING, choices ARRAY<STRING>, prompts ARRAY<STRUCT<prompt: STRING, object_ids: ARRAY<STRING>, answers: ARRAY<STRING>>>, "
    "image_path STRING, image_base64 STRING, image_paths ARRAY<STRING>, camera_name STRING, camera_names ARRAY<STRING>, current_image_path STRING, "
    "previous_image_path STRING, current_timestamp BIGINT, previous_timestamp BIGINT, current_bbox ARRAY<INT>, previous_bbox ARRAY<INT>, data STRING"
)
ANSWER = (
    "answer_type STRING, choices ARRAY<STRING>, answer STRING, text STRING, value DOUBLE, box ARRAY<DOUBLE>, boxes ARRAY<ARRAY<DOUBLE>>, "
    "score DOUBLE, scores ARRAY<DOUBLE>, object_id STRING, prompt STRING"
)
# The data set's kinds of questions and answers, label, colour and type names, thresholds in metres a second, and question texts.
QUESTION_TYPES = (
    "single_image", "single_image_single_object", "single_image_multi_prompt", "single_image_multi_choice", "single_base64_image_multi_choice",
    "multi_image_lidar", "multi_image", "multi_frame_multi_choice", "multi_image_single_object",
)
ANSWER_TYPES = ("object_2d", "multi_object_2d", "raw_text", "multiple_choice", "regression")
LABELS_BY_GROUP = {
    "Pedestrians": ["Adult Pedestrian", "Child Pedestrian", "Construction Worker", "Police / Emergency Worker", "Wheelchair User"],
    "Cyclists and Motorbikes": ["Cyclist", "Motorbike", "Motorcyclist"],
    "Cars": ["Sedan", "SUV", "Pickup Truck", "Hatchback", "Coupe", "Van", "Police Car"],
    "Truck / Bus Shaped": ["Box Truck", "Bus", "Truck", "Articulated Bus", "Vehicular Trailer", "Truck Cab", "School Bus"],
    "Construction and Road Equipment": ["Construction Barrier", "Directional Arrowboard", "Construction Vehicle", "Traffic Light Trailer", "Message Board Trailer"],
    "Traffic and Informational Signs": [
        "Information Sign", "Street Sign", "Parking Sign", "Speed Limit Sign", "Stop Sign", "Bus Sign", "Warning Sign", "Radar Speed Sign",
        "Yield Sign", "Pedestrian Detour Sign",
    ],
}
LABELS = [x for group in LABELS_BY_GROUP.values() for x in group]
COLORS = ["beige", "green", "yellow", "black", "white", "silver", "brown", "gray", "purple", "blue", "orange", "gold", "red"]
DISPLAY = {"TYPE_VEHICLE": "Vehicle", "TYPE_PEDESTRIAN": "Pedestrian", "TYPE_SIGN": "Sign", "TYPE_CYCLIST": "Cyclist"}
MOVING_ABOVE = {"TYPE_VEHICLE": 2.8, "TYPE_PEDESTRIAN": 1.1, "TYPE_CYCLIST": 1.5}
BANDS = {
    "TYPE_VEHICLE": [("stationary", 0.0, 2.8), ("slow speed", 2.8, 11.11), ("medium speed", 11.11, 19.44), ("highway speed", 19.44, INF)],
    "TYPE_PEDESTRIAN": [("stationary", 0.0, 1.1), ("walking", 1.1, 2.3), ("jogging", 2.3, 3.0), ("running", 3.0, INF)],
    "TYPE_SIGN": [("stationary", 0.0, INF)],
    "TYPE_CYCLIST": [("stationary", 0.0, 1.5), ("slow moving", 1.5, 8.33), ("fast", 8.33, INF)],
}
HEADINGS = ["towards", "away", "left", "right"]
MOVEMENTS = [*HEADINGS, "not moving"]
DIRECTION_PHRASE = {"towards": "towards the camera", "left": "towards the left of the camera", "right": "towards the right of the camera", "away": "away from the camera"}
FACING_TEXT = {
    ("TYPE_VEHICLE", "stationary"): "Are there any stationary vehicles facing {}?",
    ("TYPE_VEHICLE", "slow speed"): "Are there any vehicles travelling at a slow speed facing {}?",
    ("TYPE_VEHICLE", "medium speed"): "Are there any vehicles travelling at a medium speed facing {}?",
    ("TYPE_VEHICLE", "highway speed"): "Are there any vehicles travelling at highway speed facing {}?",
    ("TYPE_PEDESTRIAN", "stationary"): "Are there any stationary pedestrians facing {}?",
    ("TYPE_PEDESTRIAN", "walking"): "Are there any pedestrians walking and facing {}?",
    ("TYPE_PEDESTRIAN", "jogging"): "Are there any pedestrians jogging and facing {}?",
    ("TYPE_PEDESTRIAN", "running"): "Are there any pedestrians running and facing {}?",
    ("TYPE_SIGN", "stationary"): "Are there any signs facing {}?",
    ("TYPE_CYCLIST", "stationary"): "Are there any stationary cyclists facing {}?",
    ("TYPE_CYCLIST", "slow moving"): "Are there any slow moving cyclists facing {}?",
    ("TYPE_CYCLIST", "fast"): "Are there any fast moving cyclists facing {}?",
}
MOVING_TEXT = {
    ("TYPE_VEHICLE", "stationary"): "Are there any stationary vehicles?",
    ("TYPE_VEHICLE", "slow speed"): "Are there any vehicles travelling at a slow speed {}?",
    ("TYPE_VEHICLE", "medium speed"): "Are there any vehicles travelling at a medium speed {}?",
    ("TYPE_VEHICLE", "highway speed"): "Are there any vehicles travelling at highway speed {}?",
    ("TYPE_PEDESTRIAN", "stationary"): "Are there any stationary pedestrians?",
    ("TYPE_PEDESTRIAN", "walking"): "Are there any pedestrians walking {}?",
    ("TYPE_PEDESTRIAN", "jogging"): "Are there any pedestrians jogging {}?",
    ("TYPE_PEDESTRIAN", "running"): "Are there any pedestrians running {}?",
    ("TYPE_SIGN", "stationary"): "Are there any signs?",
    ("TYPE_CYCLIST", "stationary"): "Are there any stationary cyclists?",
    ("TYPE_CYCLIST", "slow moving"): "Are there any cyclists going slowly {}?",
    ("TYPE_CYCLIST", "fast"): "Are there any cyclists going fast {}?",
}
ATTRIBUTE_TEXT = {
    "_color_prompt": [
        "What color is the object in the red box? Choose from: {}",
        "What color is the object highlighted in red? Select from: {}",
        "Which color best describes the object in the red box? Options: {}",
    ],
    "_label_prompt": [
        "What type of object is in the red box? Choose from: {}",
        "What is the object in the red rectangle? Select from: {}",
        "Which category best describes the object in the red box? Options: {}",
    ],
    "_heading_prompt": [
        "Which direction is the object in the red box facing? Choose from: {}",
        "What direction is the object highlighted in red facing? Select from: {}",
    ],
    "_movement_direction_prompt": [
        "Which direction is the object in the red box moving? Choose from: {}",
        "What direction is the object highlighted in red moving? Select from: {}",
    ],
    "_speed_prompt": ["How fast is the object in the red box moving? Choose from: {}"],
}
SCENARIO_TEXT = {
    "head_on": ["Are the ego vehicle and the {} traveling directly towards each other?", "Is the {} on a direct collision course with the ego vehicle?", "Are the ego vehicle and the {} moving head-on towards each other?"],
    "object_approaching": ["Is the {} moving towards the ego vehicle?", "Is the {} approaching the ego vehicle?", "Is the {} heading towards the ego vehicle?"],
    "ego_approaching": ["Is the ego vehicle moving towards the {}?", "Is the ego vehicle approaching the {}?", "Is the ego vehicle heading towards the {}?"],
    "general_convergence": ["Are the ego vehicle and the {} getting closer to each other?", "Is the distance between the ego vehicle and the {} decreasing?", "Are the ego vehicle and the {} converging?"],
    "parallel_diverging": ["Are the ego vehicle and the {} moving in the same direction away from each other?", "Is the {} moving away from the ego vehicle in the same direction?"],
    "object_diverging": ["Is the {} moving away from the ego vehicle?", "Is the {} heading away from the ego vehicle?"],
    "ego_diverging": ["Is the ego vehicle moving away from the {}?", "Is the ego vehicle heading away from the {}?"],
    "general_divergence": ["Are the ego vehicle and the {} moving apart?", "Is the distance between the ego vehicle and the {} increasing?"],
}
#: Texts by question; one is drawn for each sample.  Those on the scene as a whole name no object.
TRAJECTORY_TEXT = {
    "_prompt_faster_than_ego": ["Is the {} moving faster than the ego vehicle?"],
    "_prompt_parallel_motion": ["Is the {} moving parallel or perpendicular to the ego vehicle?", "What is the relative motion direction of the {} compared to ego?"],
    "_prompt_approaching_stop_sign": [
        "Is the ego vehicle approaching a stop sign?",
        "Is there a stop sign ahead that the ego vehicle is approaching?",
        "Is the ego vehicle getting closer to a stop sign?",
        "Is there a stop sign that the ego vehicle is moving towards?",
        "Is the ego vehicle heading towards a stop sign?",
        "Is the ego vehicle nearing a stop sign?",
        "Can you see a stop sign that the ego vehicle is approaching?",
    ],
    "_prompt_vehicle_future_path": [
        "Is there a vehicle in the ego vehicle's future path?",
        "Is there a vehicle ahead in the ego vehicle's path?",
        "Can you see a vehicle in front of the ego vehicle?",
        "Is there a vehicle blocking the ego vehicle's path ahead?",
    ],
}
APPROACH_BOUNDS = {"Pedestrian": (2.0, 10.0), "Cyclist": (2.0, 15.0), "Vehicle": (2.0, 25.0)}
ZONES = {
    "location_sf": "America/Los_Angeles", "location_phx": "America/Phoenix", "location_mtv": "America/Los_Angeles", "location_la": "America/Los_Angeles",
    "location_det": "America/Detroit", "location_sea": "America/Los_Angeles", "location_chd": "America/Phoenix", "location_other": "America/Los_Angeles",
}
DAY_PERIODS = [(5, 8, "Early Morning (5-8 AM)"), (8, 11, "Morning (8-11 AM)"), (11, 13, "Midday (11 AM-1 PM)"), (13, 17, "Afternoon (1-5 PM)"), (17, 20, "Evening (5-8 PM)")]
NIGHT = "Night (8 PM-5 AM)"
QUESTION_KINDS = {
    "_object_movement_direction_type": ("binary", "Movement Status"),
    "_object_facing_type": ("binary", "Orientation"),
    "_label_prompt": ("attribute", "Fine-grained Classification"),
    "_color_prompt": ("attribute", "Color Recognition"),
    "_heading_prompt": ("attribute", "Facing Direction"),
    "_speed_prompt": ("motion", "Speed Assessment"),
    "_movement_direction_prompt": ("motion", "Movement Direction"),
    "_prompt_faster_than_ego": ("motion", "Relative Motion Analysis"),
    "_prompt_approaching_stop_sign": ("motion", "Traffic Element Recognition"),
    "_prompt_moving_towards_ego": ("motion", "Trajectory Analysis"),
    "_prompt_parallel_motion": ("motion", "Relative Motion Direction"),
    "_prompt_vehicle_future_path": ("motion", "Path Conflict Detection"),
}
CHOICES = 4
MAX_DISTANCE = 20.0
MIN_LIDAR = 10
FRAME_SECONDS = 0.1


def bands(spark: SparkSession) -> DataFrame:
    """type, band, position, lo, hi: one row for each speed band (fixed size)."""
    rows = [(t, b, i, lo, hi) for t, each in BANDS.items() for i, (b, lo, hi) in enumerate(each)]
    return spark.createDataFrame(rows, "type string, band string, position int, lo double, hi double")


def question_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in QUESTION_KINDS.items()], "question_name string, category string, subtype string")
