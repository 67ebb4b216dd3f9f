"""Greedy matching at many thresholds and its average precision, by one row for each box, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import detection, scan
from lanewise.plans import geometry

LEVELS = [0.3, 0.5, 0.7]


def boxes_of(seed, n=500):
    rng = random.Random(seed)
    out, ids = [], {}
    for _ in range(n):
        image = rng.choice([1, 1, 1, 2, 3, 14, 25, 36, 47, -8, None])
        ids[image] = ids.get(image, 0) + 1
        x, y = rng.randrange(12), rng.randrange(6)
        score = rng.choice([0.5, 0.5, 0.25, rng.random(), rng.random(), None, float("nan")])
        out.append((image, ids[image], rng.random() < 0.3, score, float(x), float(y), x + 10.0, y + 12.0))
    return out


def by_score(row):
    """Descending, NaN first, none last."""
    return (row is None, row == row, -row if row is not None and row == row else 0)


def matched_boxes(rows, threshold):
    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        both = max(0, w) * max(0, h)
        return round(both / (240 - both), 9)

    out = set()
    for image in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == image]
        free = [r for r in mine if r[2]]
        for f in sorted((r for r in mine if not r[2]), key=lambda r: (by_score(r[3]), r[1])):
            best = min(((-iou(f, t), t[1], t) for t in free if iou(f, t) >= threshold), default=None)
            if best:
                free.remove(best[2])
                out.add((image, f[1]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "image int, box_id int, truth boolean, score double, x1 double, y1 double, x2 double, y2 double").withColumn("prompt", F.col("image") % 3)


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 5), (3, 40)])
def test_average_precision_at_thresholds(spark, seed, ranges):
    rows = boxes_of(seed)
    b = frame(spark, rows)
    levels = detection.greedy_levels(b, LEVELS)
    want = [matched_boxes(rows, t) for t in LEVELS]
    assert {(r.image, r.found_id): r.levels for r in levels.collect()} == {x: sum(1 << k for k, m in enumerate(want) if x in m) for x in set().union(*want)}
    positives = b.where("truth").groupBy("prompt").agg(F.count("*").alias("positives"))
    got = {(r.prompt, r.threshold): r.ap for r in detection.average_precision_at(b.where("not truth"), levels.withColumn("prompt", F.col("image") % 3), positives, ["prompt"], LEVELS, ranges=ranges).collect()}
    sure = {}
    for p in (0, 1, 2, -2):
        found = sorted((r for r in rows if r[0] is not None and r[0] % 3 * (r[0] > 0) - (-r[0] % 3) * (r[0] < 0) == p and not r[2]), key=lambda r: (by_score(r[3]), r[0], r[1]))
        goal = sum(r[2] for r in rows if r[0] is not None and r[0] % 3 * (r[0] > 0) - (-r[0] % 3) * (r[0] < 0) == p)
        for t, m in zip(LEVELS, want, strict=True):
            tp, curve = 0, []
            for n, r in enumerate(found, 1):
                tp += (r[0], r[1]) in m
                curve.append((tp / goal, tp / n))
            if found and goal:
                sure[p, t] = sum(max((y for x, y in curve if x * 100 >= k - 1e-9), default=0) for k in range(101)) / 101
    assert got == pytest.approx(sure)


def test_a_prompt_without_matches_has_none(spark):
    b = frame(spark, [(1, 1, True, None, 0.0, 0.0, 10.0, 10.0), (1, 2, False, 0.5, 50.0, 50.0, 60.0, 60.0)])
    positives = b.where("truth").groupBy("prompt").agg(F.count("*").alias("positives"))
    levels = detection.greedy_levels(b, LEVELS).withColumn("prompt", F.col("image") % 3)
    assert [tuple(r) for r in detection.average_precision_at(b.where("not truth"), levels, positives, ["prompt"], LEVELS).orderBy("threshold").collect()] == [(1, t, 0.0) for t in LEVELS]


@pytest.mark.parametrize("ranges", [1, 9])
def test_counts_go_on_across_batches_and_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", None, "b", *"cdefgh"]), rng.randrange(50)) for _ in range(3000)]
    seen, marks = {}, []
    for r in sorted(rows, key=str):
        seen[r] = seen.get(r, 0) + 1
        if rng.random() < 0.2:
            marks.append((*r, seen[r], rng.randrange(1, 4)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        each, groups = scan.counted(spark.createDataFrame(rows, "g string, o int"), spark.createDataFrame(marks, "g string, o int, nth int, levels int"), ["g"], {"o": True}, 2, ranges)
        got = sorted(((r.g, r.n, r.levels, tuple(r.sums)) for r in each.collect()), key=str)
        assert {r.g for r in groups.collect()} == {r[0] for r in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sums = [], {}
    for g, o, nth, levels in sorted(marks, key=lambda m: (str(m[0]), -m[1], m[2])):
        s = sums[g] = tuple(x + (levels >> k & 1) for k, x in enumerate(sums.get(g, (0, 0))))
        want.append((g, sum(r[0] == g and r[1] > o for r in rows) + nth, levels, s))
    assert got == sorted(want, key=str)


def shuffled_rows(spark, run):
    """Rows that the stages of run() wrote to shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["mean_average_precision", "average_precision_by_threshold"])
def test_a_box_is_shuffled_once_for_all_thresholds(spark, small, name):
    n = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert shuffled_rows(spark, lambda: getattr(geometry, name)(spark, small).collect()) < 3 * n


def test_mean_over_copies_with_equal_scores(spark, small, tmp_path):
    """Copies of all boxes in other images: each score is tied across images, and ranges part the ties."""
    duckdb = pytest.importorskip("duckdb")
    li = spark.read.parquet(f"{small}/lineitem.parquet")
    copies = li.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("l_orderkey", F.col("l_orderkey") + F.col("k") * 100_000).drop("k")
    copies.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {}
    assert shuffled_rows(spark, lambda: got.update(map(tuple, geometry.mean_average_precision(spark, str(tmp_path)).collect()))) < 3 * copies.count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == dict(con.execute(geometry.query.__globals__["SQL"]["mean_average_precision"]).fetchall())
