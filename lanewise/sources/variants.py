"""Questions and answers of any kind as semi-structured columns: nothing that a file holds is lost, and each kind has a typed view.

A sample's question and answer are strings of JSON.  Both are parsed to VARIANT, which keeps fields that no schema names.  The field
``question_type`` (``answer_type``) tells the kind.  Samples that aren't JSON or of a kind that isn't known go to a quarantine with
the reason and their text, so that a new kind doesn't stop a job and can be read again later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that kinds of questions and answers have, beside the common ones.
COMMON = {"question_type": "string", "question_name": "string", "question_id": "string", "generator_name": "string", "question": "string"}
PLACE = {"scene_id": "string", "timestamp": "bigint"}
IMAGE = {"image_path": "string", "camera_name": "string", **PLACE}
IMAGES = {"image_paths": "array<string>", "camera_names": "array<string>", **PLACE}
QUESTION_KINDS = {
    "single_image": IMAGE,
    "single_image_single_object": {**IMAGE, "object_id": "string"},
    "single_image_multi_prompt": {**IMAGE, "timestamp": "double", "prompts": "array<struct<prompt: string, object_ids: array<string>, answers: array<string>>>"},
    "single_image_multi_choice": {**IMAGE, "choices": "array<string>"},
    "single_base64_image_multi_choice": {"image_base64": "string", "choices": "array<string>", **PLACE},
    "multi_image": {**IMAGES, "choices": "array<string>"},
    "multi_image_lidar": IMAGES,
    "multi_image_single_object": {**IMAGES, "object_id": "string"},
    "multi_frame_multi_choice": {
        "current_image_path": "string", "previous_image_path": "string", "current_timestamp": "bigint", "previous_timestamp": "bigint",
        "current_bbox": "array<int>", "previous_bbox": "array<int>", "choices": "array<string>", "scene_id": "string",
    },
}
ANSWER_KINDS = {
    "object_2d": {"box": "array<double>", "score": "double", "object_id": "string", "prompt": "string"},
    "multi_object_2d": {"boxes": "array<array<double>>", "scores": "array<double>", "prompt": "string"},
    "raw_text": {"text": "string"},
    "multiple_choice": {"choices": "array<string>", "answer": "string"},
    "regression": {"value": "double"},
}


def _problem(side: str, kinds: dict) -> Column:
    kind = F.col(f"{side}_type")
    return (
        F.when(F.col(f"{side}_text").isNull(), f"no {side}")
        .when(F.col(side).isNull(), f"the {side} isn't JSON")
        .when(kind.isNull(), f"the {side} has no type")
        .when(~kind.isin(*kinds), F.concat(F.lit(f"unknown type of {side}: "), kind))
    )


def parsed(samples: DataFrame) -> DataFrame:
    """samples (question and answer as text, and any other columns) with question and answer as VARIANT, question_text, answer_text,
    question_type, answer_type and problem: why the sample can't be taken, or null."""
    out = samples.withColumnsRenamed({"question": "question_text", "answer": "answer_text"})
    for side in ("question", "answer"):
        out = out.withColumn(side, F.try_parse_json(F.col(f"{side}_text")))
        out = out.withColumn(f"{side}_type", F.try_variant_get(F.col(side), f"$.{side}_type", "string"))
    return out.withColumn("problem", F.coalesce(_problem("question", QUESTION_KINDS), _problem("answer", ANSWER_KINDS)))


def accepted(samples: DataFrame) -> DataFrame:
    """The samples of ``parsed`` that are of known kinds."""
    return samples.where("problem is null").drop("problem", "question_text", "answer_text")


def quarantined(samples: DataFrame) -> DataFrame:
    """The others, with their texts as they are."""
    return samples.where("problem is not null").drop("question", "answer", "question_type", "answer_type").withColumnsRenamed({"question_text": "question", "answer_text": "answer"})


def view(samples: DataFrame, kind: str, side: str = "question") -> DataFrame:
    """The samples of one kind with its fields as typed columns named side_field; a field that is missing or of another type is null.
    The whole question and answer stay as they are."""
    kinds = {"question": QUESTION_KINDS, "answer": ANSWER_KINDS}[side]
    if kind not in kinds:
        raise ValueError(f"no {side} of type {kind}; there are {', '.join(sorted(kinds))}")
    fields = {**(COMMON if side == "question" else {}), **kinds[kind]}
    return samples.where(F.col(f"{side}_type") == kind).select("*", *[F.try_variant_get(F.col(side), f"$.{f}", t).alias(f"{side}_{f}") for f, t in fields.items() if f != f"{side}_type"])


def encoded(samples: DataFrame) -> DataFrame:
    """Question and answer as JSON again, unknown fields included."""
    return samples.withColumns({side: F.to_json(side) for side in ("question", "answer")}).drop("question_type", "answer_type")
