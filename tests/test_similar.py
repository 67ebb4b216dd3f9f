"""Similarity joins, matrices and the metric contract, against brute force and NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import geometry as g
from lanewise.operators import metrics, similar


def texts(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 14))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        out.append((i, rng.choice([w, w, w, [], None, ["same"]])))
    return out


@pytest.mark.parametrize(("seed", "percent"), [(1, 90), (2, 60), (3, 34), (4, 100)])
def test_nearest_equals_all_pairs(spark, seed, percent):
    rows, known = texts(seed, 150), [(f"k{i:03}", w) for i, w in texts(seed + 50, 80)]
    got = similar.nearest(
        spark.createDataFrame(rows, "id int, w array<string>"), spark.createDataFrame(known, "name string, v array<string>"), F.col("w"), F.col("v"), "name", percent
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        a = set(r.w or ())
        best = min(((-len(a & set(v)) / len(a | set(v)), name) for name, v in known if a and v and 100 * len(a & set(v)) >= percent * len(a | set(v))), default=None)
        assert (r.nearest, r.similarity) == ((best[1], -best[0]) if best else (None, None))


def test_a_hundred_thousand_texts_without_a_nested_loop(spark):
    words = F.split(F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * (i + 3) % 9973).cast("string")) for i in range(12)]), " ")
    rows = spark.range(100_000).select("id", words.alias("w"))
    known = rows.where("id % 1000 = 1").select(F.col("id").alias("k"), F.concat(F.slice("w", 1, 11), F.array(F.lit("end"))).alias("v"))
    out = similar.nearest(rows, known, F.col("w"), F.col("v"), "k", 80)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where("id % 1000 = 1 and nearest is not null").count() == 100


def shuffled_bytes(spark, run):
    """Bytes that the stages of run() wrote to shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("alike", [True, False])
def test_no_pair_carries_words(spark, alike):
    """A group of near copies, and texts that share common words only: what is shuffled goes with the texts, not with their pairs."""
    rng = random.Random(9)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(base) if alike else [f"word{rng.randrange(900)}" for _ in range(300)]
        for _ in range(6):
            w[rng.randrange(300)] = f"own{rng.randrange(10**6)}"
        rows.append((i, w))
    df = spark.createDataFrame(rows, "id int, w array<string>")
    known = df.where("id % 4 = 0").select(F.concat_ws(" ", "w").alias("t"), F.col("w").alias("v"))
    got = []
    assert shuffled_bytes(spark, lambda: got.extend(similar.nearest(df, known, F.col("w"), F.col("v"), "t", 60).collect())) < 4 * sum(len(" ".join(w)) for _, w in rows)
    sets = {i: set(w) for i, w in rows}
    for r in got[::17]:
        best = min(((-len(sets[r.id] & sets[i]) / len(sets[r.id] | sets[i]), " ".join(w)) for i, w in rows if i % 4 == 0 and 100 * len(sets[r.id] & sets[i]) >= 60 * len(sets[r.id] | sets[i])), default=None)
        assert (r.nearest, r.similarity) == ((best[1], -best[0]) if best else (None, None))


def test_inverse(spark):
    rng = np.random.default_rng(2)
    each = [rng.normal(size=(4, 4)) for _ in range(40)] + [np.eye(4)[[1, 3, 0, 2]], np.diag([1e-3, 1, 1e3, 2]) @ rng.normal(size=(4, 4)), rng.normal(size=(3, 3)), np.array([[4.0]])]
    bad = [np.zeros((4, 4)), np.outer([1, 2, 3, 4], [1, 0, 2, 1]), None]
    rows = [(i, m.tolist()) for i, m in enumerate(each)] + [(100 + i, None if m is None else m.astype(float).tolist()) for i, m in enumerate(bad)] + [(200, [[1.0, 2.0], [3.0]]), (201, [[1.0, None], [0.0, 1.0]]), (202, [])]
    df = spark.createDataFrame(rows, "i int, m array<array<double>>").withColumn("inv", g.inverse(F.col("m")))
    got = {r.i: r for r in df.withColumn("p", g.product(F.col("m"), F.col("inv"))).collect()}
    for i, m in enumerate(each):
        assert np.allclose(got[i].inv, np.linalg.inv(m), rtol=1e-7, atol=0 if i == 41 else 1e-12) or np.abs(np.array(got[i].p) - np.eye(len(m))).max() < 1e-9
    assert all(got[i].inv is None for i in (100, 101, 102, 200, 201, 202))


ROWS = [("a", "x", "cat dog", "cat dog", ["cat dog", "no"]), ("a", "y", "cat", "cat dog", ["cat dog", "no"]), ("b", "x", None, "no", ["no"]), ("b", "x", "no", "yes", ["no", "yes"])]


def test_metrics_by_name(spark):
    df = spark.createDataFrame(ROWS, "g string, h string, prediction string, truth string, choices array<string>")
    names = ["multiple_choice", "text_similarity"]
    got = {r.g: r.asDict() for r in metrics.evaluated(df, names, ["g"]).collect()}
    assert got["a"]["multiple_choice_accuracy"] == 0.5 and got["a"]["multiple_choice_valid_share"] == 0.5 and got["a"]["text_similarity_jaccard"] == 0.75
    assert got["b"]["multiple_choice_accuracy"] == 0 and got["b"]["text_similarity_n"] == 2 and got["b"]["text_similarity_exact"] == 0
    finer = metrics.sums(df, names, ["g", "h"])
    again = metrics.figures(metrics.added(finer, names, ["g"]), names, ["g"])
    assert {r.g: r.asDict() for r in again.collect()} == got
    with pytest.raises(ValueError, match="no metric none"):
        metrics.evaluated(df, ["none"], ["g"])
    with pytest.raises(ValueError, match="needs the columns"):
        metrics.evaluated(df, ["box_overlap"], ["g"])
    with pytest.raises(ValueError, match="already"):
        metrics.register(metrics.METRICS["multiple_choice"])


def test_an_own_metric(spark):
    own = metrics.Metric("length", ("truth",), lambda: {"n": F.length("truth")}, lambda c: {"sum": F.sum(c("n")), "n": F.count("*")}, lambda c: {"mean": metrics.share(c("sum"), c("n"))})
    metrics.register(own)
    try:
        df = spark.createDataFrame(ROWS, "g string, h string, prediction string, truth string, choices array<string>")
        assert {r.g: r.length_mean for r in metrics.evaluated(df, ["length", "multiple_choice"], ["g"]).collect()} == {"a": 7.0, "b": 2.5}
    finally:
        del metrics.METRICS["length"]
