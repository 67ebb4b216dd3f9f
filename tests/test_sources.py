"""Round trips of files, the stream against the table, and the projection of boxes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.operators import scenes
from lanewise.sources import tables
from lanewise.streaming import scene_state


def test_samples_round_trip(spark, tmp_path):
    q = {"question_type": "single_image_multi_choice", "question_id": "q1", "question": "Is it?", "scene_id": "s", "timestamp": 5, "choices": ["yes", "no"]}
    a = {"answer_type": "multiple_choice", "choices": ["yes", "no"], "answer": "no"}
    (tmp_path / "in.json").write_text(json.dumps({"tag": "t", "samples": [{"question": json.dumps(q), "answer": json.dumps(a)}] * 2}))
    read = tables.read_samples(spark, str(tmp_path / "in.json"))
    rows = read.collect()
    assert len(rows) == 2 and rows[0].question.choices == ["yes", "no"] and rows[0].answer.answer == "no" and rows[0].answer.value is None
    tables.write_samples(read, str(tmp_path / "out"))
    again = tables.read_samples(spark, str(tmp_path / "out"))
    assert again.collect() == rows


def test_unknown_kinds_are_refused(spark, tmp_path):
    kinds = [("single_image_multi_choice", "multiple_choice"), ("multi_image_lidar", "regression"), ("single_base64_image_multi_choice", "raw_text"), ("single_image_single_object", "object_2d")]
    sample = lambda q, a: {"question": json.dumps({"question_type": q, "question_id": q}), "answer": json.dumps({"answer_type": a, "value": 1.5, "box": [1, 2, 3, 4], "text": "t"})}
    (tmp_path / "good.json").write_text(json.dumps({"tag": "t", "samples": [sample(*k) for k in kinds]}))
    good = tables.known_types(tables.read_samples(spark, str(tmp_path / "good.json")))
    assert good.count() == 4 and {r.answer.value for r in good.collect()} == {1.5}
    for q, a in (("no_such", "regression"), ("multi_image", "no_such"), ("multi_image", None)):
        (tmp_path / "bad.json").write_text(json.dumps({"tag": "t", "samples": [sample(q, a)]}))
        with pytest.raises(Exception, match="unknown kind"):
            tables.known_types(tables.read_samples(spark, str(tmp_path / "bad.json"))).collect()


def test_lists_batches_and_finished_outputs(spark, tmp_path):
    tables.write_list(spark.createDataFrame([("b ",), ("",), ("a",)], "s string"), "s", f"{tmp_path}/list")
    assert sorted(r.value for r in tables.read_list(spark, f"{tmp_path}/list").collect()) == ["a", "b"]
    tables.write_batches(spark.range(10).coalesce(1), f"{tmp_path}/batches", 4)
    assert len(list((tmp_path / "batches").glob("part-*.json"))) == 3
    made = []
    for _ in range(2):
        tables.once(spark, f"{tmp_path}/once", lambda: made.append(1) or spark.range(3)).count()
    assert len(made) == 1
    tables.write_by(spark.range(4).withColumn("split", F.col("id") % 2), f"{tmp_path}/by", "split")
    assert spark.read.json(f"{tmp_path}/by").where("split = 1").count() == 2
    tables.write_csv(spark.range(2), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["id"]


def test_entities(spark, tmp_path):
    (tmp_path / "scene_1.json").write_text(json.dumps({"scene_id": "1", "tfrecord_name": "x"}))
    (tmp_path / "scene_2.json").write_text(json.dumps({"scene_id": "2"}, indent=1))
    got = tables.with_file_stem(tables.read_entities(spark, str(tmp_path), schema.SCENES)).orderBy("scene_id").collect()
    assert [(r.scene_id, r.tfrecord_name, r.file_stem) for r in got] == [("1", "x", "scene_1"), ("2", None, "scene_2")]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        tables.read_entities(spark, str(tmp_path), schema.SCENES).collect()
    assert sorted(r._corrupt_record is not None for r in tables.read_entities(spark, str(tmp_path), schema.SCENES, "PERMISSIVE").collect()) == [False, False, True]
    assert tables.expect_files(spark, str(tmp_path), "*.json", 3).count() == 3
    with pytest.raises(ValueError):
        tables.expect_files(spark, str(tmp_path), "*.json", 202)


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    got = tables.read_points(spark, str(tmp_path)).orderBy("point").collect()
    assert [r["values"] for r in got] == [[0, 1], [2, 3], [4, 5]]


def test_models_are_loaded_once_a_task(spark):
    def make():
        import pandas as pd

        return lambda batch: pd.DataFrame({"id": batch.id, "text": batch.q.str.upper()})

    got = tables.predicted(spark.createDataFrame([(1, "a")], "id long, q string"), ["id", "q"], make, "id long, text string").collect()
    assert [(r.id, r.text) for r in got] == [(1, "A")]


@pytest.mark.parametrize("every", [2, 20])
def test_stream_in_batches_equals_the_table(spark, small, tmp_path, every):
    """Five batches, with a restart after two, a batch that is repeated, and one that left an unfinished folder."""
    events = spark.read.parquet(f"{small}/events.parquet")
    source = tmp_path / "in"
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    args = ("user_id", "event_type", "event_id", ["value"], {"high": F.col("value") > 95})
    state = scene_state.SceneTable(spark, f"{tmp_path}/out", *args, every=every)
    assert state.read() is None
    for k in range(5):
        events.where(F.col("event_id") % 5 == k).coalesce(1).write.parquet(f"{source}/{k}")
        if k in (1, 4):
            state.follow(stream, f"{tmp_path}/checkpoint").awaitTermination(120)
            if k == 1:
                early = scene_state.partial_state(events.where("event_id % 5 < 2"), *args)
                assert sorted(map(repr, state.read().collect())) == sorted(map(repr, early.collect()))
    batches = sorted(int(p.name) for p in (tmp_path / "out/batch").iterdir())
    assert batches == [0, 1, 2, 3, 4]
    (tmp_path / "out/batch/5").mkdir()
    again = scene_state.SceneTable(spark, f"{tmp_path}/out", *args, every=every)
    again.add(spark.read.parquet(f"{source}/4"), 4)
    want = scene_state.partial_state(events, *args)
    assert sorted(map(repr, again.read().collect())) == sorted(map(repr, want.collect()))
    lists = {r.user_id: r for r in scene_state.id_lists(again.read(), "user_id", "event_type", ["high"]).collect()}
    assert all(sorted(r.high) == r.high and not set(r.high) & set(r.no_high) for r in lists.values())

def test_windows_on_a_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = scene_state.windowed(stream, "ts", "1 hour", None, ["event_type"], "value", late="1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = scene_state.windowed(events, "ts", "1 hour", None, ["event_type"], "value")
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, want.collect()))


def test_fan_out_labels_and_projection(spark):
    eye = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    camera = {"name": "FRONT", "intrinsic": [100.0, 100.0, 50.0, 40.0], "extrinsic": eye, "metadata": {"width": 100, "height": 80}}
    frames = spark.createDataFrame([json.dumps({"scene_id": "s", "timestamp": 1, "images": [camera, {**camera, "name": "SIDE"}]})], "string").select(F.from_json("value", schema.FRAMES).alias("f")).select("f.*")
    cams = scenes.cameras(frames)
    assert [(r.name, r.pos) for r in cams.orderBy("pos").collect()] == [("FRONT", 0), ("SIDE", 1)]
    box = {"center_x": 10.0, "center_y": 0.0, "center_z": 0.0, "length": 2.0, "width": 2.0, "height": 2.0, "heading": 0.0}
    objects = spark.createDataFrame([json.dumps({"id": "o", "scene_id": "s", "timestamp": 1, "box": box, "type": "TYPE_VEHICLE", "most_visible_camera_name": "FRONT"}), json.dumps({"id": "p", "scene_id": "s", "timestamp": 1, "box": {**box, "center_x": -10.0}, "most_visible_camera_name": ""})], "string").select(F.from_json("value", schema.OBJECTS).alias("o")).select("o.*")
    assert [r.id for r in scenes.in_view(objects).collect()] == ["o"]
    from lanewise.functions.geometry import bbox, visible

    seen = scenes.projected(objects, cams.where("name = 'FRONT'")).select("id", bbox(F.col("points"), F.col("width"), F.col("height")).alias("b"), visible(F.col("points"), F.col("width"), F.col("height")).alias("v"))
    got = {r.id: (r.b, r.v) for r in seen.collect()}
    # the near side is 9 ahead: 100 * 1 / 9 = 11.1 pixels to each side of the centre
    assert got["o"] == ([38, 28, 61, 51], True) and got["p"] == ([0, 0, 0, 0], False)
    dictionary = spark.createDataFrame([("o", "Sedan")], "object_id string, value string")
    named = {r.id: (r.cvat_label, r.in_cvat) for r in scenes.labelled(objects, dictionary, dictionary.limit(0)).collect()}
    assert named == {"o": ("Sedan", True), "p": (None, False)}


def test_entities_come_back_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, 'quo"te\nline')], "id long, name string").coalesce(1)
    tables.write_entities(rows, f"{tmp_path}/lines")
    tables.write_entities(rows, f"{tmp_path}/files", one_a_file=True)
    want = {(r.id, r.name) for r in rows.collect()}
    for path, lines in ((f"{tmp_path}/lines", True), (f"{tmp_path}/files", False)):
        assert {(r.id, r.name) for r in tables.read_entities(spark, path, "id long, name string", lines=lines).collect()} == want
    assert tables.expect_files(spark, f"{tmp_path}/files", "*.json", 3).count() == 3


def test_scratch_tables_are_removed(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    tables.forget(spark)
    assert tables.cut(spark.range(5)).count() == 5
    there = glob.glob(f"{folder.removeprefix('file:')}/cut-*") + glob.glob(f"{spark.sparkContext.getCheckpointDir() or folder}/cut-*".removeprefix("file:"))
    assert there
    assert tables.forget(spark) == 1 and tables.forget(spark) == 0
    assert not [p for p in there if glob.glob(p)]


def test_shuffled_places_rows_of_empty_and_full_tables(spark):
    from lanewise.operators import sampling

    assert sampling.shuffled(spark.range(0), "s", "id").count() == 0
    got = [r.position for r in sampling.shuffled(spark.range(500), "s", "id").orderBy("id").collect()]
    assert sorted(got) == list(range(500)) and got != sorted(got)
