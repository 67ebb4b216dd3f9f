"""Sequences, trajectories, sampling, evaluation and detection against NumPy and plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.operators import detection, evaluation, questions, sampling, scenes, stats, trajectories
from lanewise.operators import sequence as s


def series(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, idx int, v double")


@pytest.mark.parametrize("values", [[1.0], [1.0, 4.0], [3.0, 1.0, 4.0, 1.0, 5.0]])
def test_gradient_is_numpys(spark, values):
    w = s.ordered(["k"], ["idx"])
    got = [r.g for r in series(spark, values).select("idx", s.gradient(F.col("v"), w).alias("g")).orderBy("idx").collect()]
    assert got == ([None] if len(values) == 1 else pytest.approx(list(np.gradient(values, 0.1))))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=12))
def test_interpolation_is_numpys(spark, values):
    at = [i for i, v in enumerate(values) if v is not None]
    got = [r.g for r in series(spark, values).select("idx", s.interpolated(F.col("v"), F.col("idx").cast("double"), ["k"], ["idx"]).alias("g")).orderBy("idx").collect()]
    if not at:
        assert got == [None] * len(values)
    else:
        assert got == pytest.approx(list(np.interp(range(len(values)), at, [values[i] for i in at])))


def test_cumulative_counts_need_no_row(spark):
    w = s.ordered(["k"], ["idx"])
    got = [r.c for r in series(spark, [1.0, -1.0, 2.0, None, 3.0]).select("idx", s.cumulative(F.col("v") > 0, w).alias("c")).orderBy("idx").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_first_frame_is_paired_with_the_next(spark):
    got = s.previous_pairs(series(spark, [0.0, 0.0, 0.0]), ["k"]).orderBy("idx").collect()
    assert [(r.previous_idx, r.current_idx) for r in got] == [(0, 1), (0, 1), (1, 2)]
    assert [(r.previous_idx, r.current_idx) for r in s.previous_pairs(series(spark, [0.0]), ["k"]).collect()] == [(0, 0)]


def test_best_frame_takes_the_earliest(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 5.0), ("a", 0, 1.0), ("b", 7, 0.0)], "k string, idx int, v double")
    assert sorted((r.k, r.idx) for r in s.best_frame(df, ["k"], F.col("v"), ["idx"]).collect()) == [("a", 1), ("b", 7)]


def scene(spark, ego, objects):
    frames = spark.createDataFrame([("s", i, float(x), float(y), 0.0, 0.0, 1.0, 0.0) for i, (x, y) in enumerate(ego)], "scene_id string, timestamp long, ex double, ey double, ez double, lx double, ly double, lz double")
    seen = [("s", t, o, kind, label, float(x), float(y), 0.0, float(v), 20) for o, (kind, label, at) in objects.items() for t, x, y, v in at]
    return frames, spark.createDataFrame(seen, "scene_id string, timestamp long, object_id string, kind string, label string, x double, y double, z double, speed double, lidar int")


def test_short_scenes_and_gaps(spark):
    frames, seen = scene(spark, [(0, 0), (1, 0)], {"a": ("Vehicle", "Sedan", [(0, 5, 0, 1)])})
    assert trajectories.tracks(frames, seen).count() == 0
    frames, seen = scene(spark, [(0, 0), (1, 0), (2, 0), (3, 0)], {"a": ("Vehicle", "Sedan", [(1, 5, 0, 1), (3, 9, 0, 3)])})
    got = trajectories.tracks(frames, seen).orderBy("idx").collect()
    assert [r.x for r in got] == [5, 5, 7, 9] and [r.observed for r in got] == [False, True, False, True] and [r.speed for r in got] == [1, 1, 2, 3]


def test_observations_without_a_position_or_a_frame(spark):
    frames, seen = scene(spark, [(0, 0)] * 5, {"a": ("Vehicle", "Sedan", [(-1, 90, 0, 9), (0, 2, 0, 1), (2, 50, 0, 7), (4, 6, 0, 3), (8, 90, 0, 9)])})
    seen = seen.withColumn("x", F.when(F.col("timestamp") != 2, F.col("x")))
    got = trajectories.tracks(frames, seen).orderBy("idx").collect()
    assert [r.x for r in got] == [2, 3, 4, 5, 6] and [r.speed for r in got] == [1, 1.5, 7, 2.5, 3]
    assert [r.observed for r in got] == [True, False, True, False, True] and [r.lidar for r in got] == [20, None, 20, None, 20]


def test_approaching_needs_three_frames(spark):
    ego = [(0, 0)] * 7
    for n, want in ((3, 1), (2, 0)):
        at = [(i, 20 - min(i, n) * 1.0, 0, 5) for i in range(7)]
        frames, seen = scene(spark, ego, {"a": ("Vehicle", "Sedan", at)})
        got = trajectories.moving_towards_ego(trajectories.tracks(frames, seen)).collect()
        assert len(got) == want
        if want:
            assert (got[0].answer, got[0].idx, got[0].scenario) == ("yes", 3, "object_approaching")


def test_standing_ego_answers_faster(spark):
    frames, seen = scene(spark, [(0, 0)] * 4, {"a": ("Vehicle", None, [(i, 5, 0, 3) for i in range(4)]), "b": ("Vehicle", None, [(i, 5, 0, 1) for i in range(4)])})
    got = {(r.object_id, r.answer, r.idx) for r in trajectories.faster_than_ego(trajectories.tracks(frames, seen)).collect()}
    # an unclear object has a ratio above 1.5 but isn't fast enough; a 'no' needs a small ratio
    assert got == {("a", "yes", 0)}


@pytest.mark.parametrize(("angle", "want"), [(0, "parallel"), (10, "parallel"), (45, None), (85, "perpendicular"), (90, "perpendicular"), (170, "parallel")])
def test_angles(spark, angle, want):
    a = np.radians(angle)
    at = [(i, 5 + i * np.cos(a), i * np.sin(a), 9) for i in range(4)]
    frames, seen = scene(spark, [(i, 0) for i in range(4)], {"a": ("Vehicle", "Sedan", at)})
    got = [r.answer for r in trajectories.parallel_motion(trajectories.tracks(frames, seen)).collect()]
    assert got == ([want] if want else [])


def test_stop_signs(spark):
    ego = [(i * 1.0, 0) for i in range(6)]
    frames, seen = scene(spark, ego, {"near": ("Sign", "Stop Sign", [(i, 20, 0, 0) for i in range(6)]), "passed": ("Sign", "Stop Sign", [(i, -3, 0, 0) for i in range(6)]), "other": ("Sign", "Yield Sign", [(i, 9, 0, 0) for i in range(6)])})
    t = trajectories.tracks(frames, seen)
    got = Counter((r.object_id, r.answer) for r in trajectories.approaching_stop_sign(t).collect())
    assert got == {("near", "yes"): 5, ("passed", "no"): 5}
    # a sign of any kind counts
    assert trajectories.frames_without_sign(t.select("scene_id", "idx").distinct(), t.where("object_id = 'other'")).count() == 0
    assert trajectories.frames_without_sign(t.select("scene_id", "idx").distinct(), t.where("object_id = 'other'"), near=5).count() == 5


def test_samples_are_the_same_in_any_partitioning(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a = {r.id for r in sampling.stratified(df.repartition(1), ["g"], 7, "x", "id").collect()}
    b = {r.id for r in sampling.stratified(df.repartition(9), ["g"], 7, "x", "id").collect()}
    assert a == b and len(a) == 21
    split = Counter(r.split for r in sampling.split_by_count(df, 101, "42", "id").collect())
    assert split == {"train": 101, "val": 899}


def counts_of(spark, counts):
    return spark.createDataFrame([("g", a, n) for a, n in counts.items()], "g string, answer string, n long")


@pytest.mark.parametrize(("counts", "balance"), [({"a": 100, "b": 1}, True), ({"a": 50, "b": 50}, False), ({"a": 9}, False), ({"a": 400, "b": 300, "c": 1, "d": 1, "e": 1, "f": 1}, True)])
def test_balancing(spark, counts, balance):
    rows = spark.createDataFrame([("g", a, f"{a}{i}") for a, n in counts.items() for i in range(n)] + [("g", None, "none")], "g string, answer string, k string")
    total = sum(counts.values())
    got = Counter(r.answer for r in sampling.balanced(rows, ["g"], "answer", total, "s", "k").collect())
    assert all(got[a] <= n for a, n in counts.items()) and None not in got
    if not balance:
        assert got == counts
    else:
        root = {a: n**0.5 for a, n in counts.items()}
        goal = {a: max(max(2, total // (4 * len(counts))), max(1, int(total * r / sum(root.values())))) for a, r in root.items()}
        planned = sum(goal.values())
        goal = {a: max(1, int(t * total / planned)) for a, t in goal.items()} if planned > total else goal
        assert got == {a: min(goal[a], n) for a, n in counts.items()}


def test_metrics_of_balance(spark):
    r = sampling.balance_metrics(counts_of(spark, {"a": 3, "b": 1}), ["g"]).first()
    p = np.array([0.75, 0.25])
    assert r.entropy == pytest.approx(-(p * np.log(p)).sum()) and r.balance_score == pytest.approx(np.exp(r.entropy) / 2) and r.dominant_ratio == 0.75


def test_scene_cap(spark):
    rows = spark.createDataFrame([("big" if i < 60 else f"s{i % 4}", i) for i in range(100)] + [(None, 1000)], "scene string, k int")
    got = Counter(r.scene for r in sampling.capped_scenes(rows, "scene", "s", "k").collect())
    assert got["big"] == 40 and got[None] == 1 and sum(got.values()) == 81


def test_negatives_fill_up_with_what_was_not_seen(spark):
    seen = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("t", "b", 1)], "scene string, x string, y int")
    universe = spark.createDataFrame([(x, y) for x in "ab" for y in (1, 2)], "x string, y int")
    got = sampling.negatives(seen, universe, ["scene"], ["x", "y"], "n").collect()
    assert Counter(r.scene for r in got) == {"s": 2, "t": 1}
    assert not {(r.scene, r.x, r.y) for r in got} & {("s", "a", 1), ("s", "a", 2), ("t", "b", 1)}


def test_choices_keep_the_answer(spark):
    all_ = [f"c{i}" for i in range(9)]
    df = spark.range(50).select("id", F.array(*map(F.lit, all_)).alias("c"), F.lit("c4").alias("a"))
    got = df.select(sampling.fewer_choices(F.col("c"), F.col("a"), 4, "s", F.col("id")).alias("r")).collect()
    assert all(len(set(r.r)) == 4 and "c4" in r.r for r in got) and len({r.r.index("c4") for r in got}) == 4


RESULTS = [("m1", "a", "a"), ("m1", "a", "b"), ("m1", "b", "b"), ("m1", "c", None), ("m2", "a", None), ("m2", "b", None)]


def test_class_counts(spark):
    df = spark.createDataFrame(RESULTS, "model string, truth string, prediction string")
    got = {(r.model, r["class"]): (r.tp, r.fp, r.fn, r.tn, r.support) for r in evaluation.class_counts(df, ["model"]).collect()}
    want = {}
    for m in ("m1", "m2"):
        mine = [(t, p) for x, t, p in RESULTS if x == m]
        for c in {x for pair in mine for x in pair if x}:
            tp = sum(t == p == c for t, p in mine)
            fp = sum(t != c and p == c for t, p in mine)
            fn = sum(t == c and p != c for t, p in mine)
            want[(m, c)] = (tp, fp, fn, len(mine) - tp - fp - fn, tp + fn)
    assert got == want
    m = {(r.model, r["class"]): r for r in evaluation.class_metrics(evaluation.class_counts(df, ["model"])).collect()}
    assert m[("m2", "a")].f1 == 0 and m[("m1", "b")].precision == 0.5 and m[("m1", "b")].f2 == pytest.approx(5 * 0.5 / (4 * 0.5 + 1))


def test_confusion_adds_up(spark):
    rng = random.Random(0)
    rows = [(rng.choice("xy"), rng.choice("abc"), rng.choice(["a", "b", "c", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "model string, truth string, prediction string")
    total = evaluation.confusion(df, ["model"]).where("prediction is not null").agg(F.sum("n")).first()[0]
    assert total == sum(p is not None for *_, p in rows) == evaluation.summary(df, []).first().valid
    for by in ("true", "pred", "all"):
        out = evaluation.normalised(evaluation.confusion(df, ["model"]), by, ["model"]).collect()
        assert all(0 <= r.share <= 1 for r in out)


def test_every_truth_needs_a_prediction(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "k int, truth string")
    twice = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 0)], "k int, prediction string, file int")
    assert sorted((r.k, r.prediction) for r in evaluation.matched(truth, twice, "k", "file").collect()) == [(1, "y"), (2, "z")]
    with pytest.raises(Exception, match="no prediction for 2"):
        evaluation.matched(truth, twice.where("k = 1"), "k").collect()


def test_aligned_needs_the_same_keys(spark):
    truth = spark.createDataFrame([(0, "a", "yes"), (1, "b", "no")], "i int, id string, truth string")
    good = spark.createDataFrame([(0, "a", "no"), (1, "b", "no")], "i int, id string, prediction string")
    assert sorted(r.prediction for r in evaluation.aligned(truth, good, "i", "id").collect()) == ["no", "no"]
    for bad in ([(0, "a", "no"), (1, "c", "no")], [(0, "a", "no")], [(0, "a", "no"), (1, "b", "no"), (2, "c", "no")]):
        with pytest.raises(Exception, match="no match at position"):
            evaluation.aligned(truth, spark.createDataFrame(bad, good.schema), "i", "id").collect()


def test_typed_predictions_need_the_same_choices(spark):
    rows = spark.createDataFrame([("a", ["a", "b"], ["a", "b"]), ("c", ["a", "b"], ["a", "b"])], "answer string, choices array<string>, asked array<string>")
    assert [r.prediction for r in evaluation.typed(rows, "answer", "choices", "asked").collect()] == ["a", None]
    with pytest.raises(Exception, match="other choices"):
        evaluation.typed(rows.withColumn("asked", F.array(F.lit("a"))), "answer", "choices", "asked").collect()


def test_shared_failures(spark):
    rows = [("q", "m1", "a", "b")] * 2 + [("q", "m2", "a", "b")] + [("q", "m1", "c", "b")] * 5 + [("q", "m2", "a", "a")]
    got = evaluation.cross_model_failures(spark.createDataFrame(rows, "question string, model string, truth string, prediction string"), "question", "model").collect()
    assert [(r.truth, r.prediction, r.n_models, r.n, r.score, r.by_model) for r in got] == [("a", "b", 2, 3, 6, "m1:2,m2:1")]


def test_reports():
    board = [{"model": "a_b", "f1": 10.0}, {"model": "c", "f1": 20.0}, {"model": "d", "f1": 5.0}]
    text = evaluation.latex(board, ["model", "f1"])
    assert r"a\_b & \underline{10.0}" in text and r"c & \textbf{20.0}" in text and "d & 5.0" in text
    assert "10.0 % of 1,000" in evaluation.failure_report([], [{"model": "m", "accuracy": 0.1, "total": 1000}])


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image int, box_id long, score double, x1 double, y1 double, x2 double, y2 double")


def test_suppression(spark):
    found = boxes(spark, [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 3, 0.7, 20.0, 0.0, 30.0, 10.0), (2, 4, 0.1, 0.0, 0.0, 10.0, 10.0), (1, 5, 0.6, 2.0, 0.0, 12.0, 10.0)])
    assert sorted(r.box_id for r in detection.suppressed(found, "image", 0.5).collect()) == [1, 3, 4]


def test_greedy_matching_takes_each_truth_once(spark):
    truth = boxes(spark, [(1, 1, 1.0, 0.0, 0.0, 10.0, 10.0)])
    found = boxes(spark, [(1, 11, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 12, 0.9, 0.0, 0.0, 10.0, 8.0), (1, 13, 0.4, 50.0, 50.0, 60.0, 60.0)])
    got = {(r.threshold, r.found_id): r.matched for r in detection.greedy(truth, found, [0.5, 0.9]).collect()}
    assert got == {(0.5, 12): True, (0.5, 11): False, (0.5, 13): False, (0.9, 12): False, (0.9, 11): True, (0.9, 13): False}
    flags = {r.box_id: r.hit for r in detection.hits(truth, found, 0.5).collect()}
    assert flags == {11: True, 12: True, 13: False}


def test_a_cap_of_boxes_is_only_by_choice(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    truth = spark.createDataFrame([(1, i, *box) for i in range(130)], "image int, box_id int, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([(1, i, *box, 1 - i / 1000) for i in range(130)], "image int, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert detection.greedy(truth, found, [0.5]).where("matched").count() == 130
    assert detection.greedy(truth, found, [0.5], most=100).where("matched").count() == 100


def test_average_precision(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.random(), rng.random() < 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, score double, hit boolean")
    positives = 30
    got = detection.average_precision(detection.precision_recall(df, positives, ["g"], "hit", [F.col("score").desc(), F.col("i")]), ["g"]).first().ap
    tp, curve = 0, []
    for n, r in enumerate(sorted(rows, key=lambda r: -r[2]), 1):
        tp += r[3]
        curve.append((tp / positives, tp / n))
    assert got == pytest.approx(sum(max((p for rec, p in curve if rec * 100 >= k - 1e-9), default=0) for k in range(101)) / 101)


def test_failing_rules_are_counted_once(spark):
    df = spark.createDataFrame([("FRONT", "TYPE_VEHICLE", 20.0, 10, 1.0), ("FRONT", "TYPE_VEHICLE", 20.1, 10, 1.0), ("FRONT", "TYPE_SIGN", 50.0, 0, 0.0), (None, "TYPE_SIGN", 1.0, 0, 0.0), ("FRONT", "TYPE_CYCLIST", 1.0, 9, 1.0), ("FRONT", None, 1.0, 9, 1.0)], "c string, t string, d double, l int, v double")
    rules = scenes.best_view_rules(F.col("t"), F.col("c"), F.col("d"), F.col("l"), F.lit(True), F.col("v"))
    assert {r.reason: r.n for r in scenes.failure_counts(df, rules).collect()} == {"passed": 1, "too_far": 1, "unknown_or_sign": 2, "no_camera_name": 1, "few_points": 1}


def test_first_table_wins(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b"), (2, "a")], "k int, v string")
    assert sorted((r.k, r.v) for r in stats.first_wins([a, b], "k").collect()) == [(1, "a"), (2, "a")]


def test_builders_are_found_by_name():
    assert set(questions.BUILDERS) == {"object_binary", "object_drawn_box", "ego_relative", "ego_relative_multi_frame", "scene_multi_choice"}
    with pytest.raises(ValueError):
        questions.get("none")


def test_drawn_box_questions(spark):
    views = spark.createDataFrame([("s", "o", "TYPE_VEHICLE", "red", None, "left", "not moving", 2.8, [0, 0, 1, 1])], "scene_id string, object_id string, type string, color string, label string, heading string, movement string, speed double, bbox array<int>")
    got = {r.question_name: r for r in questions.object_drawn_box(views).collect()}
    assert set(got) == {"_color_prompt", "_heading_prompt", "_speed_prompt", "_movement_direction_prompt"}
    assert got["_speed_prompt"].answer == "slow speed" and all(len(r.choices) == 4 and r.answer in r.choices and "{}" not in r.question for r in got.values())


def test_binary_questions_are_even(spark):
    rows = [("s", 1, "FRONT", "TYPE_VEHICLE", d, d, b) for d in ("towards", "left") for b in ("stationary", "slow speed")]
    seen = spark.createDataFrame(rows, "scene_id string, timestamp long, camera string, type string, direction string, facing string, band string")
    got = questions.object_binary(seen, seen).collect()
    assert Counter((r.question_name, r.answer) for r in got) == {(n, a): 4 for n in ("_object_movement_direction_type", "_object_facing_type") for a in ("yes", "no")}
    assert len({r.question_id for r in got}) == len(got)


def test_two_frame_questions_use_the_previous_best_camera(spark):
    single = spark.createDataFrame([("s", "o", 2, "yes"), ("s", "p", 2, "no"), ("s", "o", 0, "yes"), ("s", "q", 1, "no")], "scene_id string, object_id string, idx int, answer string").withColumn("bbox", F.lit(0))
    # object, frame, camera, shown, best
    views = [("o", 0, "FRONT", True, True), ("o", 1, "FRONT", True, False), ("o", 1, "SIDE", True, True), ("o", 2, "FRONT", True, True), ("o", 2, "SIDE", True, False), ("p", 2, "FRONT", True, True)]
    views += [("q", 0, "FRONT", False, True), ("q", 0, "SIDE", True, False), ("q", 1, "FRONT", True, True), ("q", 1, "SIDE", True, False)]
    shown = spark.createDataFrame([("s", o, i, c, [i], f"{i}{c}.jpg", v, b) for o, i, c, v, b in views], "scene_id string, object_id string, idx int, camera string, bbox array<int>, image_path string, visible boolean, best boolean")
    frames = spark.createDataFrame([("s", i) for i in range(3)], "scene_id string, idx int")
    got = {(r.object_id, r.idx): (r.previous_image_path, r.current_image_path, r.camera_name) for r in questions.ego_relative_multi_frame(single, shown, frames).collect()}
    assert got == {("o", 2): ("1SIDE.jpg", "2SIDE.jpg", "SIDE"), ("o", 0): ("0FRONT.jpg", "1FRONT.jpg", "FRONT")}
