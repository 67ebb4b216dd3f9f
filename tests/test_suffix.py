"""Least distance to the later path, against every pair of frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators.sequence import suffix_minimum

SCHEMA = "scene string, obj string, idx int, x double, y double, keep boolean"


def tracks(seed, straight):
    rng = random.Random(seed)
    path, points = [], []
    for scene, n in (("a", 70), ("b", 1), ("c", 9), ("d", 40)):
        at = [0.0, 0.0]
        for i in range(n):
            at = [at[0] + (1.0 if straight else rng.uniform(-1, 1)), at[1] + rng.uniform(-1, 1)] if scene != "d" else [3.0, 4.0]
            # some frames of the path are missing, some have no position
            if scene != "a" or not 20 <= i < 33:
                path.append((scene, i, *(at if rng.random() < 0.95 else (None, at[1]))))
        for i in range(n + 3):
            for o in range(2):
                points.append((scene, f"o{o}", i, rng.uniform(-5, 20) if rng.random() < 0.95 else None, rng.uniform(-5, 5), rng.random() < 0.9))
    points.append(("none", "o", 0, 1.0, 1.0, True))
    return path, points


@pytest.mark.parametrize(("seed", "straight", "block"), [(1, True, 8), (2, False, 8), (3, False, 1), (4, True, 1024)])
def test_equals_all_pairs(spark, seed, straight, block):
    path, points = tracks(seed, straight)
    got = suffix_minimum(spark.createDataFrame(points, SCHEMA), spark.createDataFrame(path, "scene string, idx int, ex double, ey double"), ["scene", "obj", "idx"], ("x", "y"), ("ex", "ey"), "d", F.col("keep"), block=block)
    want = {}
    for s, o, i, x, y, keep in points:
        d = [math.sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) for t, j, ex, ey in path if keep and t == s and j >= i and x is not None and ex is not None]
        want[s, o, i] = (x, y, keep, min(d) if d else None)
    rows = got.collect()
    assert {(r.scene, r.obj, r.idx): (r.x, r.y, r.keep, r.d) for r in rows} == want and len(rows) == len(want)


def test_few_frames_are_measured_in_a_long_scene(spark):
    """20,000 frames in one scene: rows that are joined stay near the points' number times a few blocks."""
    n = 20_000
    path = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("ex"), F.sin(F.col("id") / 50).alias("ey"))
    points = path.select("scene", "idx", (F.col("ex") + 3).alias("x"), (F.col("ey") + 2).alias("y"))
    got = suffix_minimum(points, path, ["scene", "idx"], ("x", "y"), ("ex", "ey"), "d", block=128)
    assert got.agg(F.count("*"), F.count("d")).first() == (n, n)
    assert got.agg(F.max("d")).first()[0] < 6
