"""Boundaries, ties and odd values of column functions, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from lanewise.functions import geometry as g
from lanewise.functions import text as tx
from lanewise.schema import BANDS


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("kind", "v", "first", "last"),
    [
        ("TYPE_VEHICLE", 2.8, "stationary", "slow speed"),
        ("TYPE_VEHICLE", 2.79, "stationary", "stationary"),
        ("TYPE_VEHICLE", 30.0, "highway speed", "highway speed"),
        ("TYPE_PEDESTRIAN", 1.1, "stationary", "walking"),
        ("TYPE_PEDESTRIAN", 2.3, "walking", "jogging"),
        ("TYPE_CYCLIST", 1.5, "stationary", "slow moving"),
        ("TYPE_SIGN", 99.0, "stationary", "stationary"),
        ("TYPE_UNKNOWN", 5.0, "stationary", "stationary"),
    ],
)
def test_bands_overlap_at_their_edges(spark, kind, v, first, last):
    assert one(spark, g.speed_band(F.lit(kind), F.lit(v))) == first
    assert one(spark, g.speed_band(F.lit(kind), F.lit(v), last=True)) == last


def test_speed_ignores_what_is_missing(spark):
    none = F.lit(None).cast("double")
    assert one(spark, g.speed(none, F.lit(3.0))) == 0.0
    assert one(spark, g.speed(F.lit(3.0), F.lit(4.0))) == 5.0
    assert one(spark, g.is_moving(F.lit("TYPE_VEHICLE"), F.lit(2.8))) is False
    assert one(spark, g.is_moving(F.lit(None).cast("string"), F.lit(9.0))) is False


def test_facing_ties_go_to_x(spark):
    assert [one(spark, g.facing(F.lit(x), F.lit(y))) for x, y in ((1.0, 1.0), (-1.0, 1.0), (0.0, 0.0), (0.1, 1.0), (0.1, -1.0))] == ["away", "towards", "towards", "left", "right"]


@pytest.mark.parametrize(("x", "y", "want"), [(0.0, 1.0, "front"), (1.0, 1.0, "front"), (1.0, 0.0, "left"), (1.0, -1.0, "left"), (-1.0, 1.0, "front"), (-1.0, 0.0, "right"), (-1.0, -1.0, "right"), (0.0, -1.0, "behind")])
def test_sectors(spark, x, y, want):
    assert one(spark, g.sector(F.lit(x), F.lit(y))) == want


def points(*rows):
    return F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(d).alias("depth"), F.lit(ok).alias("ok")) for u, v, d, ok in rows])


def test_bbox_truncates_and_clamps(spark):
    p = points((-5.7, 10.9, 1.0, True), (99.9, 20.2, 1.0, True), (50.0, 500.0, 2.0, True), (1.0, 1.0, -1.0, True), (1.0, 1.0, 1.0, False))
    assert one(spark, g.bbox(p, F.lit(80), F.lit(60))) == [0, 10, 80, 60]
    assert one(spark, g.bbox(points((1.0, 1.0, 1.0, True), (2.0, 2.0, 1.0, True)), F.lit(80), F.lit(60))) == [0, 0, 0, 0]
    assert one(spark, g.visible(points((0.0, 60.0, 1.0, True)), F.lit(80), F.lit(60))) is True
    assert one(spark, g.visible(points((0.0, 60.0, 0.0, True)), F.lit(80), F.lit(60))) is False


@pytest.mark.parametrize(("ok", "behind", "w", "h", "lidar", "want"), [(6, False, 32, 32, 5, 5120.0), (5, False, 32, 32, 5, 0.0), (8, True, 64, 64, 9, 0.0), (8, False, 31, 64, 9, 0.0), (8, False, 64, 64, 4, 0.0)])
def test_visibility(spark, ok, behind, w, h, lidar, want):
    assert one(spark, g.visibility(F.lit(ok), F.lit(behind), F.lit(w), F.lit(h), F.lit(lidar))) == want


def test_iou(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, g.iou(box(0, 0, 2, 2), box(0, 0, 2, 2))) == 1.0
    assert one(spark, g.iou(box(0, 0, 2, 2), box(3, 3, 4, 4))) == 0.0
    assert one(spark, g.iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0


def test_box_choice_takes_whole_boxes(spark):
    df = spark.createDataFrame([((1.0, None), (9.0, 9.0)), (None, (9.0, 8.0))], "s struct<x:double,y:double>, b struct<x:double,y:double>")
    assert [tuple(r.c) for r in df.select(g.centre_box(F.col("s"), F.col("b")).alias("c")).collect()] == [(1.0, None), (9.0, 8.0)]


def test_pose_and_camera_are_inverse_rotations(spark):
    a = 0.7
    m = [[math.cos(a), -math.sin(a), 0.0, 5.0], [math.sin(a), math.cos(a), 0.0, -2.0], [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 0.0, 1.0]]
    pose = F.array(*[F.array(*map(F.lit, r)) for r in m])
    world = [one(spark, c) for c in g.transform_point(pose, F.lit(1.0), F.lit(2.0), F.lit(3.0))]
    back = [one(spark, c) for c in g.rotate_to_camera(pose, *[F.lit(w - t) for w, t in zip(world, (5.0, -2.0, 1.0), strict=True)])]
    assert back == pytest.approx([1.0, 2.0, 3.0])


def parse(spark, response, choices, compat=True):
    r = one(spark, tx.parsed(F.lit(response), F.array(*map(F.lit, choices)), compat))
    return r.answer, r.parse_type


YES_NO = ["Yes", "No"]


@pytest.mark.parametrize(
    ("response", "choices", "want", "plain"),
    [
        ("yes", YES_NO, ("Yes", "exact_matching"), ("Yes", "exact_matching")),
        ("YES.", YES_NO, ("Yes", "exact_matching"), ("Yes", "exact_matching")),
        ("yes\n", YES_NO, (None, "not_parsed"), ("Yes", "exact_matching")),
        ("1. yes 2. no", YES_NO, ("yes", "ranked_listing"), ("Yes", "ranked_listing")),
        ("2 no 1 yes", YES_NO, (None, "not_parsed"), (None, "not_parsed")),
        ("yes or no", YES_NO, (None, "not_parsed"), (None, "not_parsed")),
        ("school bus", ["Bus", "School Bus"], (None, "not_parsed"), ("School Bus", "exact_matching")),
        ("Police / Emergency Worker", ["Police / Emergency Worker", "Cyclist"], (None, "not_parsed"), ("Police / Emergency Worker", "exact_matching")),
        ("", YES_NO, (None, "not_parsed"), (None, "not_parsed")),
    ],
)
def test_responses(spark, response, choices, want, plain):
    assert parse(spark, response, choices) == want
    assert parse(spark, response, choices, compat=False) == plain


def test_options(spark):
    arr = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    assert [one(spark, tx.formatted_options(arr(*v))) for v in ((), ("a",), ("a", "b"), ("a", "b", "c"))] == ["", "a", "a or b", "a, b or c"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarities(spark):
    pairs = [("a b a c", "b a a d"), ("", ""), ("x", ""), ("the cat sat on the mat", "on the mat the cat sat"), ("a a a a", "a a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, t string").orderBy("i")
    got = df.select("i", tx.rouge_l(F.col("p"), F.col("t")).alias("l"), tx.token_f1_multiset(F.col("p"), F.col("t")).alias("m"), tx.tfidf_cosine(F.col("p"), F.col("t")).alias("c"), tx.char_jaccard(F.col("p"), F.col("t"), 2).alias("n")).orderBy("i").collect()
    from collections import Counter

    for r, (p, t) in zip(got, pairs, strict=True):
        a, b = p.split(), t.split()
        assert r.l.precision == pytest.approx(lcs(a, b) / len(a) if a else 0)
        shared = sum((Counter(a) & Counter(b)).values())
        assert r.m.recall == pytest.approx(shared / len(b) if b else 0)
        assert 0 <= r.c <= 1 + 1e-9 and 0 <= r.n <= 1
    assert got[3].c == pytest.approx(1.0) and got[1].n == 0


@pytest.mark.parametrize(("hour", "want"), [(4, "Night (8 PM-5 AM)"), (5, "Early Morning (5-8 AM)"), (8, "Morning (8-11 AM)"), (11, "Midday (11 AM-1 PM)"), (13, "Afternoon (1-5 PM)"), (17, "Evening (5-8 PM)"), (20, "Night (8 PM-5 AM)")])
def test_day_periods(spark, hour, want):
    # Phoenix is 7 hours behind UTC all year
    us = ((hour + 7) * 3600) * 1_000_000
    assert one(spark, tx.day_period(F.lit(us), F.lit("America/Phoenix"))) == want


def test_daylight_saving(spark):
    from datetime import datetime, timezone

    at = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000
    assert one(spark, tx.day_period(F.lit(at(2021, 3, 14, 12, 30)), F.lit("America/Los_Angeles"))) == "Early Morning (5-8 AM)"
    assert one(spark, tx.day_period(F.lit(at(2021, 3, 13, 12, 30)), F.lit("America/Los_Angeles"))) == "Night (8 PM-5 AM)"


def test_every_band_has_its_texts():
    from lanewise.schema import FACING_TEXT, MOVING_TEXT

    keys = {(t, b) for t, each in BANDS.items() for b, _, _ in each}
    assert keys == set(FACING_TEXT) == set(MOVING_TEXT)
