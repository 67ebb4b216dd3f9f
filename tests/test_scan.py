"""Running sums, envelopes and batches by ranges, against plain loops; one group holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import detection, scan


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([0.5, 0.5, rng.random()]), rng.random() < 0.4) for i in range(n)]


def by_group(rows):
    out = {}
    for g, i, score, hit in sorted(rows, key=lambda r: (-r[2], r[1])):
        out.setdefault(g, []).append((i, score, hit))
    return out


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 7), (3, 50)])
def test_curve(spark, seed, ranges):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "g string, i int, score double, hit boolean")
    got = {(r.g, r.i): (r.tp, r.fp, r.precision, r.recall, r.envelope) for r in detection.precision_recall(df, 100, ["g"], "hit", [F.col("score").desc(), F.col("i")], ranges).collect()}
    want = {}
    for g, each in by_group(rows).items():
        tp, curve = 0, []
        for n, (i, _, hit) in enumerate(each, 1):
            tp += hit
            curve.append((i, tp, n - tp, tp / n, tp / 100))
        best = 0.0
        for i, *c in reversed(curve):
            best = max(best, c[2])
            want[g, i] = (*c, best)
    assert got == want


def test_a_group_of_all_rows_is_many_tasks(spark):
    df = spark.range(2000).select(F.lit("one").alias("g"), "id", (F.col("id") % 5 == 0).alias("hit"))
    parts = scan.ranged(df, ["g"], [F.col("id")], 8)
    sizes = [r["count"] for r in parts.groupBy(scan.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_batches(spark, size):
    rows = rows_of(5, 100)
    got = {(r.g, r.i): r.batch for r in scan.batched(spark.createDataFrame(rows, "g string, i int, score double, hit boolean"), ["i"], size, ["g"], 6).collect()}
    seen: dict = {}
    want = {}
    for g, i, _, _ in rows:
        want[g, i] = seen.get(g, 0) // size
        seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, i int, hit boolean")
    assert detection.precision_recall(df, 1, ["g"], "hit", [F.col("i")]).count() == 0
    assert scan.batched(df, ["i"], 3, ["g"]).count() == 0
