"""Samples of every kind there and back, and what goes to the quarantine."""

import json

import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.sources import variants

EXAMPLE = {
    "string": "t", "bigint": 5, "double": 2.5, "array<string>": ["a", "b"], "array<int>": [1, 2, 3, 4], "array<double>": [1.5, 2.0, 3.0, 4.0], "array<array<double>>": [[1.0, 2.0, 3.0, 4.0]],
    "array<struct<prompt: string, object_ids: array<string>, answers: array<string>>>": [{"prompt": "p", "object_ids": ["o"], "answers": []}],
}


def test_kinds_are_those_of_the_schema():
    assert set(variants.QUESTION_KINDS) == set(schema.QUESTION_TYPES) and set(variants.ANSWER_KINDS) == set(schema.ANSWER_TYPES)


def test_every_kind_there_and_back(spark):
    rows = []
    for i, (kind, fields) in enumerate(variants.QUESTION_KINDS.items()):
        answer, more = list(variants.ANSWER_KINDS.items())[i % 5]
        question = {f: EXAMPLE[t] for f, t in {**variants.COMMON, **fields}.items()} | {"question_type": kind, "data": {"free": [1, {"x": None}]}}
        rows.append((i, json.dumps(question), json.dumps({f: EXAMPLE[t] for f, t in more.items()} | {"answer_type": answer, "note": "kept"})))
    samples = variants.parsed(spark.createDataFrame(rows, "i int, question string, answer string"))
    good = variants.accepted(samples)
    back = {r.i: (json.loads(r.question), json.loads(r.answer)) for r in variants.encoded(good).collect()}
    assert back == {i: (json.loads(q), json.loads(a)) for i, q, a in rows} and variants.quarantined(samples).count() == 0
    for i, (kind, fields) in enumerate(variants.QUESTION_KINDS.items()):
        r = variants.view(good, kind).drop("question", "answer").collect()
        assert len(r) == 1 and r[0].i == i
        got = r[0].asDict(recursive=True)
        assert {f: got[f"question_{f}"] for f in fields} == {f: EXAMPLE[t] for f, t in fields.items()}
    got = variants.view(good, "regression", "answer").first()
    assert got.answer_value == 2.5
    with pytest.raises(ValueError, match="hologram"):
        variants.view(good, "hologram")


def test_quarantine(spark):
    fine = '{"question_type": "single_image", "timestamp": "noon"}'
    answer = '{"answer_type": "raw_text", "text": "x"}'
    rows = [(1, fine, answer), (2, "{", answer), (3, None, answer), (4, "[1]", answer), (5, '{"question_type": "hologram"}', answer), (6, fine, "{}"), (7, fine, '{"answer_type": null}')]
    samples = variants.parsed(spark.createDataFrame(rows, "i int, question string, answer string").withColumn("problems", F.lit("clash")))
    got = {r.i: (r.problem, r.question) for r in variants.quarantined(samples).collect()}
    assert {i: p for i, (p, _) in got.items()} == {
        2: "the question isn't JSON", 3: "no question", 4: "the question has no type", 5: "unknown type of question: hologram", 6: "the answer has no type", 7: "the answer has no type",
    }
    assert got[2][1] == "{" and got[5][1] == '{"question_type": "hologram"}'
    assert variants.view(variants.accepted(samples), "single_image").first().question_timestamp is None
