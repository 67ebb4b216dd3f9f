"""Evaluation queries on stand-ins: an order's priority is the truth, that of the customer's order before is the prediction (none for
every eleventh customer), the market segment is the model and the status the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import metrics, stats
from ..sources.tables import table
from .registry import query

RESULTS = """WITH results AS (
  SELECT o_orderkey AS row_id, c_mktsegment AS model, o_orderstatus AS question, o_orderpriority AS truth,
         CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS prediction
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    before = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_mktsegment").alias("model"), F.col("o_orderstatus").alias("question"),
        F.col("o_orderpriority").alias("truth"), F.when(F.col("o_custkey") % 11 != 0, before).alias("prediction"),
    )


def counts_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    on = " AND ".join(f"r.{x.strip()} = c.{x.strip()}" for x in keys.split(",")) if keys else "true"
    group = ", ".join(["c." + x.strip() for x in keys.split(",")] if keys else []) + (", " if keys else "")
    return f"""{RESULTS}, classes AS (SELECT DISTINCT {k}truth AS class FROM results UNION SELECT DISTINCT {k}prediction FROM results WHERE prediction IS NOT NULL),
counts AS (SELECT {group}c.class,
  count(*) FILTER (WHERE truth = class AND prediction IS NOT DISTINCT FROM class) AS tp,
  count(*) FILTER (WHERE truth <> class AND prediction IS NOT DISTINCT FROM class) AS fp,
  count(*) FILTER (WHERE truth = class AND prediction IS DISTINCT FROM class) AS fn,
  count(*) FILTER (WHERE truth <> class AND prediction IS DISTINCT FROM class) AS tn,
  count(*) FILTER (WHERE truth = class) AS support
  FROM classes c JOIN results r ON {on} GROUP BY {group}c.class),
prs AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall,
  CASE WHEN tn + fp = 0 THEN 0.0::DOUBLE ELSE tn / (tn + fp)::DOUBLE END AS specificity FROM counts),
metrics AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
  CASE WHEN 4 * precision + recall = 0 THEN 0.0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f2,
  CASE WHEN 0.25 * precision + recall = 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM prs)"""


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in ev.METRICS)
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ev.METRICS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def figures(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return ev.class_metrics(ev.class_counts(results(spark, sf_dir), keys))


@query(f"{counts_sql('model, question')} SELECT model, question, {MEANS}, CAST(sum(support) AS BIGINT) AS samples FROM metrics GROUP BY model, question")
def leaderboard_macro_prf(spark, sf_dir):
    return rounded(ev.macro(figures(spark, sf_dir, ["model", "question"]), ["model", "question"]), *ev.METRICS)


@query(f"{counts_sql('model')} SELECT model, class, tp, fp, fn, tn, support FROM counts")
def per_class_counts(spark, sf_dir):
    return ev.class_counts(results(spark, sf_dir), ["model"])


@query(f"{counts_sql('model')} SELECT model, class, support, {ROUNDED} FROM metrics")
def per_class_prf_fbeta(spark, sf_dir):
    return rounded(figures(spark, sf_dir, ["model"]).select("model", "class", "support", *ev.METRICS), *ev.METRICS)


@query(f"{counts_sql('model')} SELECT model, {', '.join(f'round(sum({m} * support) / sum(support), 6) AS {m}' for m in ev.METRICS)} FROM metrics GROUP BY model")
def weighted_prf(spark, sf_dir):
    return rounded(ev.weighted(figures(spark, sf_dir, ["model"]), ["model"]), *ev.METRICS)


@query(f"{RESULTS} SELECT question, truth, prediction, count(*) AS n FROM results GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return ev.confusion(results(spark, sf_dir), ["question"])


def _norm_sql(part: str) -> str:
    return f"""{RESULTS}, c AS (SELECT question, truth, prediction, count(*) AS n FROM results WHERE prediction IS NOT NULL GROUP BY ALL)
SELECT question, truth, prediction, n, round(n / sum(n) OVER (PARTITION BY {part}), 6) AS share FROM c"""


def _norm(spark, sf_dir, by):
    return rounded(ev.normalised(ev.confusion(results(spark, sf_dir), ["question"]), by, ["question"]), "share")


@query(_norm_sql("question, truth"))
def confusion_norm_true(spark, sf_dir):
    return _norm(spark, sf_dir, "true")


@query(_norm_sql("question, prediction"))
def confusion_norm_pred(spark, sf_dir):
    return _norm(spark, sf_dir, "pred")


@query(_norm_sql("question"))
def confusion_norm_all(spark, sf_dir):
    return _norm(spark, sf_dir, "all")


@query(f"""{RESULTS} SELECT model, count(*) AS total, count(prediction) AS valid, count(*) FILTER (WHERE truth = prediction) AS correct,
  round(count(prediction) / count(*), 6) AS valid_rate, round(count(*) FILTER (WHERE truth = prediction) / count(*), 6) AS accuracy FROM results GROUP BY model""")
def eval_summary(spark, sf_dir):
    return rounded(ev.summary(results(spark, sf_dir), ["model"]), "valid_rate", "accuracy")


@query(f"""{counts_sql('model')}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f1, 9) DESC, class) AS b, row_number() OVER (PARTITION BY model ORDER BY round(f1, 9), class) AS w FROM metrics)
SELECT model, max(class) FILTER (WHERE b = 1) AS best_class, round(max(f1) FILTER (WHERE b = 1), 6) AS best, max(class) FILTER (WHERE w = 1) AS worst_class, round(max(f1) FILTER (WHERE w = 1), 6) AS worst FROM r GROUP BY model""")
def best_worst_class(spark, sf_dir):
    return rounded(ev.best_worst(figures(spark, sf_dir, ["model"]), ["model"]), "best", "worst")


@query(f"{RESULTS} SELECT 'truth' AS dimension, truth AS value, count(*) AS n FROM results GROUP BY truth UNION ALL SELECT 'prediction', prediction, count(*) FROM results GROUP BY prediction")
def truth_and_prediction_distribution(spark, sf_dir):
    return stats.by_dimension(results(spark, sf_dir), ["truth", "prediction"])


@query(f"""{RESULTS} SELECT model, question, grouping(model, question)::BIGINT AS level, count(*) AS total, round(count(*) FILTER (WHERE truth = prediction) / count(*), 6) AS accuracy
FROM results GROUP BY GROUPING SETS ((model, question), (model), (question), ())""")
def grouped_leaderboard(spark, sf_dir):
    r = results(spark, sf_dir)
    out = r.groupingSets([["model", "question"], ["model"], ["question"], []], "model", "question").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("total"), F.round(ev.ratio(F.count_if(F.col("truth") == F.col("prediction")), F.count("*")), 6).alias("accuracy")
    )
    return out


BOARD = f"{counts_sql('model, question')}, board AS (SELECT model, question, avg(f1) AS f1 FROM metrics GROUP BY model, question)"


def board(spark, sf_dir):
    return ev.macro(figures(spark, sf_dir, ["model", "question"]), ["model", "question"]).select("model", "question", "f1")


@query(f"{BOARD} SELECT model, question, round(f1, 6) AS f1, place FROM (SELECT *, dense_rank() OVER (PARTITION BY question ORDER BY round(f1, 9) DESC)::INTEGER AS place FROM board) WHERE place <= 2")
def best_second_highlight(spark, sf_dir):
    return rounded(ev.highlights(board(spark, sf_dir), ["question"], "f1"), "f1")


@query(f"""{BOARD}, m AS (SELECT *, min(f1) OVER (PARTITION BY question) AS lo, max(f1) OVER (PARTITION BY question) AS hi FROM board)
SELECT model, question, round(f1, 6) AS f1, round(CASE WHEN hi - lo < 1e-6 THEN 50.0 ELSE (f1 - lo) * 100 / (hi - lo) END, 4) AS scaled FROM m""")
def relative_f1_minmax(spark, sf_dir):
    return ev.min_max_scaled(board(spark, sf_dir), ["question"], "f1").withColumns({"f1": F.round("f1", 6), "scaled": F.round("scaled", 4)})


@query(f"""{BOARD} SELECT model, {', '.join(f"round(coalesce(avg(f1) FILTER (WHERE question = '{q}'), 0.0), 6) AS \"{q}\"" for q in "FOPX")} FROM board GROUP BY model""")
def pivot_f1_by_category(spark, sf_dir):
    return rounded(ev.pivoted(board(spark, sf_dir), "model", "question", list("FOPX"), "f1"), *"FOPX")


@query(f"""{RESULTS}, s AS (SELECT model, question, count(*) FILTER (WHERE truth = prediction) / count(*) AS accuracy FROM results WHERE row_id % 2 = 0 GROUP BY ALL),
m AS (SELECT model, question, count(*) FILTER (WHERE truth = prediction) / count(*) AS accuracy FROM results WHERE row_id % 2 = 1 GROUP BY ALL)
SELECT s.model, s.question, round(s.accuracy, 6) AS single, round(m.accuracy, 6) AS multi, round(m.accuracy - s.accuracy, 6) AS delta FROM s JOIN m ON s.model = m.model AND s.question = m.question""")
def single_vs_multi_delta(spark, sf_dir):
    r = results(spark, sf_dir)
    side = lambda odd: ev.summary(r.where(F.col("row_id") % 2 == odd), ["model", "question"])
    return rounded(ev.compared(side(0), side(1), ["model", "question"], "accuracy"), "single", "multi", "delta")


@query(f"{RESULTS} SELECT truth, prediction, count(*) AS n FROM results WHERE truth <> prediction GROUP BY ALL HAVING count(*) >= 5 ORDER BY n DESC, truth, prediction LIMIT 10")
def common_failures_topk(spark, sf_dir):
    return ev.failures(results(spark, sf_dir), [], 5).orderBy(F.col("n").desc(), "truth", "prediction").limit(10)


CROSS = f"""{RESULTS}, e AS (SELECT question, model, truth, prediction, count(*) AS n FROM results WHERE truth <> prediction GROUP BY ALL),
x AS (SELECT question, truth, prediction, count(*) AS n_models, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(model || ':' || n)), ',') AS by_model FROM e GROUP BY ALL HAVING count(*) >= 2 AND sum(n) >= 3)"""


@query(f"{CROSS} SELECT *, n_models * n AS score FROM x")
def cross_model_failures(spark, sf_dir):
    return ev.cross_model_failures(results(spark, sf_dir), "question", "model")


@query(f"{CROSS} SELECT n_models, count(*) AS patterns, round(avg(n), 6) AS mean_n FROM x GROUP BY n_models")
def failure_histogram(spark, sf_dir):
    found = ev.cross_model_failures(results(spark, sf_dir), "question", "model")
    return found.groupBy("n_models").agg(F.count("*").alias("patterns"), F.round(F.avg("n"), 6).alias("mean_n"))


MATRIX = f"""{RESULTS}, c AS (SELECT model, question, truth, prediction, count(*) AS n FROM results WHERE prediction IS NOT NULL GROUP BY ALL),
k AS (SELECT model, question, count(DISTINCT v) AS k FROM (SELECT model, question, truth AS v FROM c UNION ALL SELECT model, question, prediction FROM c) GROUP BY ALL),
f AS (SELECT c.model, c.question, any_value(k) AS k, CAST(sum(n) AS BIGINT) AS total, coalesce(sum(n) FILTER (WHERE truth = prediction), 0) / sum(n) AS accuracy,
  CASE WHEN any_value(k) < 2 THEN 0.0 ELSE count(*) FILTER (WHERE truth <> prediction) / (any_value(k) * (any_value(k) - 1)) END AS error_diversity
  FROM c JOIN k ON c.model = k.model AND c.question = k.question GROUP BY c.model, c.question)"""


def matrices(spark, sf_dir):
    return ev.matrix_figures(ev.confusion(results(spark, sf_dir), ["model", "question"]), ["model", "question"])


@query(f"{MATRIX} SELECT model, question, k, total, round(accuracy, 6) AS accuracy, round(error_diversity, 6) AS error_diversity FROM f")
def error_diversity(spark, sf_dir):
    return rounded(matrices(spark, sf_dir).select("model", "question", "k", "total", "accuracy", "error_diversity"), "accuracy", "error_diversity")


def _selection(spark, sf_dir, column):
    return matrices(spark, sf_dir).select("model", "question", F.round(column, 6).alias("score")).orderBy(F.col("score").desc(), "model", "question").limit(5)


@query(f"{MATRIX} SELECT model, question, round(error_diversity * ln(total + 1), 6) AS score FROM f ORDER BY score DESC, model, question LIMIT 5")
def matrix_selection_diversity(spark, sf_dir):
    return _selection(spark, sf_dir, "by_diversity")


@query(f"{MATRIX} SELECT model, question, round(1 - 2 * abs(accuracy - 0.5), 6) AS score FROM f ORDER BY score DESC, model, question LIMIT 5")
def matrix_selection_performance(spark, sf_dir):
    return _selection(spark, sf_dir, "by_performance")


@query(f"{MATRIX} SELECT model, question, round((1 - accuracy) * error_diversity, 6) AS score FROM f ORDER BY score DESC, model, question LIMIT 5")
def matrix_selection_error(spark, sf_dir):
    return _selection(spark, sf_dir, "by_error")


@query("""SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY lang""")
def binary_classifier_by_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    t, p = F.col("quality") == 1, F.col("toxic") == 1
    return rows.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


@query("SELECT o1.o_orderkey AS row_id, o1.o_orderpriority AS truth, o2.o_orderstatus AS prediction FROM orders o1 JOIN orders o2 ON o1.o_orderkey = o2.o_orderkey")
def matched_predictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ev.matched(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("truth")), o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("prediction")), "row_id")


@query("""WITH v AS (SELECT conv_id, role, count(*) AS votes, min(turn) AS p FROM conversations GROUP BY ALL)
SELECT conv_id, arg_max(role, votes * 100000 - p) AS role, max(votes) AS votes FROM v GROUP BY conv_id""")
def majority_vote(spark, sf_dir):
    return ev.majority(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@query("SELECT 'p_type' AS dimension, p_type AS value, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size")
def stats_by_dimension(spark, sf_dir):
    return stats.by_dimension(table(spark, sf_dir, "part"), ["p_type", "p_brand", "p_size"])


@query("""WITH r AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS depth FROM r GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
SELECT r_name, n_name, c_mktsegment, n, depth, round(CASE depth WHEN 0 THEN 1.0 WHEN 1 THEN n / sum(n) OVER (PARTITION BY depth)
  WHEN 2 THEN n / sum(n) OVER (PARTITION BY depth, r_name) ELSE n / sum(n) OVER (PARTITION BY depth, r_name, n_name) END, 6) AS share FROM h""")
def hierarchy_rollup_pct(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", "c_mktsegment")
    return rounded(stats.hierarchy(rows, ["r_name", "n_name", "c_mktsegment"]), "share")


@query("""WITH d AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 GROUP BY n_name)
SELECT d.r_name, d.n_name, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.n_name = c.n_name""")
def zero_filled_hierarchy(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    counts = s.where("s_acctbal > 9000").join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))
    return stats.zero_filled(counts, n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name"), ["n_name"])


A = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'"
B = "SELECT o_orderkey, o_orderpriority AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"


def _slices(spark, sf_dir):
    """Two tables that overlap in the open orders and together hold all of them; the second one names the priority as its status."""
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice"), o.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_orderpriority").alias("o_orderstatus"), "o_totalprice")


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY f) AS r FROM (SELECT 0 AS f, * FROM ({A}) UNION ALL SELECT 1, * FROM ({B}))) WHERE r = 1")
def dedupe_union_first_wins(spark, sf_dir):
    return stats.first_wins(list(_slices(spark, sf_dir)), "o_orderkey")


@query(f"{A} UNION ALL {B}")
def union_no_dedupe(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return a.unionByName(b)


@query(f"SELECT o_orderkey FROM ({A}) INTERSECT SELECT o_orderkey FROM ({B})")
def split_intersection(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return a.select("o_orderkey").intersect(b.select("o_orderkey"))


@query(f"SELECT o_orderkey FROM ({A}) EXCEPT SELECT o_orderkey FROM ({B})")
def split_difference(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return a.select("o_orderkey").exceptAll(b.select("o_orderkey"))


@query(f"""{RESULTS}, a AS (SELECT model, question, count(*) FILTER (WHERE truth = prediction) / count(*) AS accuracy FROM results GROUP BY ALL)
SELECT model, {', '.join(f"round(coalesce(max(accuracy) FILTER (WHERE question = '{q}'), 0.0), 6) AS \"{q}\"" for q in "FOP")} FROM a GROUP BY model""")
def accuracy_heat_map(spark, sf_dir):
    return rounded(ev.pivoted(ev.summary(results(spark, sf_dir), ["model", "question"]), "model", "question", list("FOP"), "accuracy"), *"FOP")


@query(f"{counts_sql('model, question')}, b AS (SELECT model, question, avg(f1) AS f1, avg(recall) AS recall, sum(support) AS n FROM metrics GROUP BY ALL) SELECT model, round(sum(f1 * n) / sum(n), 6) AS f1, round(sum(recall * n) / sum(n), 6) AS recall FROM b GROUP BY model")
def sample_weighted_leaderboard(spark, sf_dir):
    board = ev.macro(figures(spark, sf_dir, ["model", "question"]), ["model", "question"])
    return rounded(ev.weighted_mean(board, ["model"], ["f1", "recall"], "samples"), "f1", "recall")


@query(f"""{RESULTS}, c AS (SELECT model, truth, prediction, count(*) AS n FROM results GROUP BY ALL), w AS (SELECT model, CAST(sum(n) AS BIGINT) AS total, round(coalesce(sum(n) FILTER (WHERE truth = prediction), 0) / sum(n), 6) AS accuracy FROM c GROUP BY model)
SELECT model, total, accuracy, CAST(row_number() OVER (PARTITION BY model ORDER BY n DESC, truth, prediction) AS INTEGER) AS rank, truth, prediction, n FROM c JOIN w USING (model) WHERE truth <> prediction QUALIFY rank <= 3""")
def model_top_confusions(spark, sf_dir):
    return rounded(ev.model_failures(results(spark, sf_dir), "model"), "accuracy")


@query("SELECT l_orderkey AS position, o_orderpriority AS truth, n AS prediction FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey")
def aligned_predictions(spark, sf_dir):
    """Orders and counts of their lines, by position, with the key as what must agree."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("position")).agg(F.count("*").alias("prediction")).withColumn("key", F.col("position"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("truth"))
    truth = orders.join(lines.select("position"), "position", "left_semi")
    return ev.aligned(truth, lines, "position", "key").select("position", "truth", "prediction")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS prediction FROM orders")
def typed_predictions(spark, sf_dir):
    choices = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM"]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", choices.alias("choices"), choices.alias("truth_choices"))
    return ev.typed(rows, "o_orderpriority", "choices", "truth_choices").select("o_orderkey", "prediction")


METRIC_ROWS = """WITH r AS (SELECT p_brand, p_name AS prediction, replace(p_name, 'red', 'blue') AS truth, ['red widget', 'small ring', 'blue gear', 'blue widget'] AS choices, p_size FROM part),
t AS (SELECT *, list_distinct(string_split(prediction, ' ')) AS a, list_distinct(string_split(truth, ' ')) AS b, list_contains(choices, prediction) AS valid FROM r),
m AS (SELECT *, len(list_intersect(a, b)) AS shared, least(p_size, 20) * least(10, p_size) AS i FROM t),
s AS (SELECT *, shared / len(list_distinct(list_concat(a, b))) AS jaccard, 2 * shared / (len(a) + len(b)) AS f1, i / (p_size * 10 + 20 * p_size - i) AS iou FROM m)"""


@query(f"""{METRIC_ROWS} SELECT p_brand, count(*) AS multiple_choice_n, round(count(*) FILTER (WHERE valid AND prediction = truth) / count(*), 6) AS multiple_choice_accuracy, round(count(*) FILTER (WHERE valid) / count(*), 6) AS multiple_choice_valid_share,
count(*) AS text_similarity_n, round(count(*) FILTER (WHERE prediction = truth) / count(*), 6) AS text_similarity_exact, round(avg(jaccard), 6) AS text_similarity_jaccard, round(avg(f1), 6) AS text_similarity_f1,
count(*) AS box_overlap_n, round(avg(iou), 6) AS box_overlap_mean_iou, round(count(*) FILTER (WHERE round(iou, 9) >= 0.5) / count(*), 6) AS box_overlap_hit_share FROM s GROUP BY p_brand""")
def metrics_in_one_pass(spark, sf_dir):
    """Three metrics by brand from one aggregation; sums by brand and type are added up to those by brand."""
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select(
        "p_brand", "p_type", F.col("p_name").alias("prediction"), F.replace("p_name", F.lit("red"), F.lit("blue")).alias("truth"), F.array(*map(F.lit, ["red widget", "small ring", "blue gear", "blue widget"])).alias("choices"),
        F.array(F.lit(0.0), F.lit(0.0), size, F.lit(10.0)).alias("prediction_box"), F.array(F.lit(0.0), F.lit(0.0), F.lit(20.0), size).alias("truth_box"),
    )
    names = ["multiple_choice", "text_similarity", "box_overlap"]
    out = metrics.figures(metrics.added(metrics.sums(rows, names, ["p_brand", "p_type"]), names, ["p_brand"]), names, ["p_brand"])
    return out.select("p_brand", *[c if c.endswith("_n") else F.round(c, 6).alias(c) for c in out.columns[1:]])
