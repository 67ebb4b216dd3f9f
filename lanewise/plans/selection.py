"""Queries on sampling and balancing; all choices are md5 ranks, so SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, scan
from ..sources.tables import table
from .registry import query

METRICS = """m AS (SELECT {g} CAST(sum(n) AS BIGINT) AS total, count(*) AS num_choices, min(n) AS min_count, max(n) AS max_count, max(n) / sum(n) AS dominant_ratio, sum(-p * ln(p)) AS entropy FROM (
  SELECT *, n / sum(n) OVER ({w}) AS p FROM c) {b})"""
SHOWN = "total, num_choices, min_count, max_count, round(dominant_ratio, 6) AS dominant_ratio, round(entropy, 6) AS entropy, round(exp(entropy), 6) AS effective_answers, round(exp(entropy) / num_choices, 6) AS balance_score"
FIGURES = ("dominant_ratio", "entropy", "effective_answers", "balance_score")


def shown(df):
    return df.withColumns({c: F.round(c, 6) for c in FIGURES})


@query(f"WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), {METRICS.format(g='o_orderstatus,', w='PARTITION BY o_orderstatus', b='GROUP BY o_orderstatus')} SELECT o_orderstatus, {SHOWN} FROM m")
def balance_metrics(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return shown(sampling.balance_metrics(counts, ["o_orderstatus"]))


@query(f"WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL), {METRICS.format(g='', w='', b='')} SELECT {SHOWN} FROM m")
def scene_balance_metrics(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return shown(sampling.balance_metrics(counts, []))


TARGETS = """t AS (SELECT *, greatest(greatest(2, CAST(floor(1000 / (count(*) OVER w * 4)) AS BIGINT)), greatest(1, CAST(floor(round(1000 * sqrt(n) / sum(sqrt(n)) OVER w, 9)) AS BIGINT))) AS planned FROM c WINDOW w AS (PARTITION BY o_orderstatus)),
u AS (SELECT *, least(CASE WHEN sum(planned) OVER w > 1000 THEN greatest(1, CAST(floor(round(planned * 1000 / sum(planned) OVER w, 9)) AS BIGINT)) ELSE planned END, n) AS target FROM t WINDOW w AS (PARTITION BY o_orderstatus))"""


@query(f"WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), {TARGETS} SELECT o_orderstatus, o_orderpriority, n, CAST(target AS BIGINT) AS target FROM u")
def sqrt_targets(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return sampling.answer_targets(counts, ["o_orderstatus"], 1000)


@query(f"""WITH rows AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice < 400000 THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders), c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM rows GROUP BY ALL),
{METRICS.format(g='o_orderstatus,', w='PARTITION BY o_orderstatus', b='GROUP BY o_orderstatus')},
d AS (SELECT o_orderstatus, num_choices > 1 AND round(exp(entropy) / num_choices, 9) <= 0.7 AND (round(dominant_ratio, 9) > 0.6 OR (min_count < 2 AND num_choices > 2)) AS b FROM m), {TARGETS},
r AS (SELECT rows.o_orderkey, o_orderstatus, o_orderpriority, target, b, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('b|' || o_orderkey), o_orderkey) AS ra,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('b|' || o_orderkey), o_orderkey) AS rb FROM rows JOIN u USING (o_orderstatus, o_orderpriority) JOIN d USING (o_orderstatus))
SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS least FROM r WHERE (b AND ra <= target) OR (NOT b AND rb <= 1000) GROUP BY ALL""")
def balanced_sample_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice") < 400000, "low").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return sampling.balanced(rows, ["o_orderstatus"], "o_orderpriority", 1000, "b", "o_orderkey").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@query("""WITH s AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 0 ELSE user_id END AS scene FROM events), k AS (SELECT count(*) * 2 // count(DISTINCT scene) AS cap FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY md5('s|' || event_id), event_id) AS rn FROM s) SELECT scene, count(*) AS n, min(event_id) AS least FROM r, k WHERE rn <= cap GROUP BY scene""")
def scene_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, F.lit(0).cast("long")).otherwise(F.col("user_id")).alias("scene"))
    return sampling.capped_scenes(rows, "scene", "s", "event_id").groupBy("scene").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query("SELECT event_id, user_id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 100")
def md5_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, "42", "event_id")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS r FROM events) WHERE r <= 20")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], 20, "42", "event_id")


@query("SELECT user_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || user_id)) <= 7 THEN 'train' ELSE 'val' END AS split FROM (SELECT DISTINCT user_id FROM events)")
def train_val_split(spark, sf_dir):
    return sampling.split_by_count(table(spark, sf_dir, "events").select("user_id").distinct(), 7, "42", "user_id")


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('f|' || o_orderkey), 1, 7) AS BIGINT) < 214748364 THEN 'train' ELSE 'val' END AS split FROM orders")
def fraction_split(spark, sf_dir):
    return sampling.split_by_share(table(spark, sf_dir, "orders").select("o_orderkey"), 0.8, "f", "o_orderkey")


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
b AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY md5('e|' || user_id), user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c) SELECT * FROM b WHERE before < 450""")
def early_stop_scenes(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sampling.early_stop(counts, "user_id", "n", 300, "e")


@query("""WITH o AS (SELECT DISTINCT user_id, event_type, CAST(hour(ts) AS BIGINT) AS band FROM events), u AS (SELECT event_type, band FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(24)) AS band)),
w AS (SELECT user_id, count(*) AS wanted FROM o GROUP BY user_id), f AS (SELECT user_id, event_type, band, wanted FROM w, u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = w.user_id AND o.event_type = u.event_type AND o.band = u.band))
SELECT user_id, event_type, band FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('n|' || user_id || '|' || event_type || '|' || band), event_type, band) AS r FROM f) WHERE r <= wanted""")
def negative_combinations(spark, sf_dir):
    """Of each user as many pairs of type and hour that no event has as of those that one has."""
    e = table(spark, sf_dir, "events")
    seen = e.select("user_id", "event_type", F.hour("ts").cast("long").alias("band"))
    universe = e.select("event_type").distinct().withColumn("band", F.explode(F.array(*[F.lit(i).cast("long") for i in range(24)])))
    return sampling.negatives(seen, universe, ["user_id"], ["event_type", "band"], "n")


@query("""WITH k AS (SELECT least(count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 0)) AS n FROM labels)
SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('p|' || doc_id), doc_id) AS r FROM labels), k WHERE r <= n""")
def pos_neg_ratio_balance(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic", (F.col("toxic") == 1).alias("flag"))
    return sampling.ratio_balanced(rows, "flag", "p", "doc_id").select("doc_id", "toxic")


@query("""WITH c AS (SELECT list_sort(list(DISTINCT p_type)) AS choices FROM part), d AS (SELECT p_partkey, p_type, md5('cd|' || p_partkey || '|' || t) AS dd, md5('co|' || p_partkey || '|' || t) AS dn, t FROM part, c, unnest(choices) AS x(t)),
r AS (SELECT *, CASE WHEN t = p_type THEN 0 ELSE row_number() OVER (PARTITION BY p_partkey, t = p_type ORDER BY dd, t) END AS r FROM d)
SELECT p_partkey, p_type AS answer, array_to_string(list(t ORDER BY dn, t), ',') AS choices FROM r WHERE r <= 3 GROUP BY p_partkey, p_type""")
def choice_downsample4(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kinds = [r[0] for r in part.select("p_type").distinct().orderBy("p_type").collect()]
    choices = sampling.fewer_choices(F.array(*map(F.lit, kinds)), F.col("p_type"), 4, "c", F.col("p_partkey"))
    return part.select("p_partkey", F.col("p_type").alias("answer"), F.array_join(choices, ",").alias("choices"))


@query("SELECT o_orderkey, o_orderstatus, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 100) AS INTEGER) AS batch FROM orders")
def batched_sink_assignment(spark, sf_dir):
    return scan.batched(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100, ["o_orderstatus"])


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY md5('o|' || event_id), event_id) - 1 AS position FROM events")
def shuffled_order(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "events").select("event_id", "event_type"), "o", "event_id")
