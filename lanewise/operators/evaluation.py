"""Evaluation of answers: confusion, per-class figures, leaderboards, failures.

Every function starts from one aggregation by (keys, truth, prediction); all figures are then derived from those few rows, so
the answers themselves are shuffled once, as partial counts.  A null prediction is an invalid one: it counts as a miss of its
true class and never as a false alarm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def matched(truth: DataFrame, predictions: DataFrame, key: str, rank: str | None = None) -> DataFrame:
    """Truth with its prediction; of several predictions the last by ``rank``.  A truth without prediction raises an error."""
    if rank:
        others = [c for c in predictions.columns if c != key]
        predictions = predictions.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_p")).select(key, "_p.*")
    joined = truth.join(predictions.withColumn("_there", F.lit(True)), key, "left")
    complete = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return joined.where(complete).drop("_there")


def aligned(truth: DataFrame, predictions: DataFrame, position: str, key: str) -> DataFrame:
    """Truth with the prediction at the same position; an error where one of both is missing or their keys differ."""
    others = [c for c in predictions.columns if c not in (position, key)]
    p = predictions.select(position, F.col(key).alias("_key"), *others)
    joined = truth.join(p, position, "full")
    same = F.when(F.coalesce(F.col(key) != F.col("_key"), F.lit(True)), F.raise_error(F.concat(F.lit("no match at position "), F.col(position).cast("string")))).otherwise(F.lit(True))
    return joined.where(same).drop("_key")


def typed(rows: DataFrame, answer: str, choices: str, truth_choices: str) -> DataFrame:
    """Adds prediction: the typed answer if it is one of its choices, else null.  Choices other than the truth's are an error."""
    same = F.when(~F.col(choices).eqNullSafe(F.col(truth_choices)), F.raise_error(F.lit("a prediction has other choices than its truth"))).otherwise(F.lit(True))
    return rows.where(same).withColumn("prediction", F.when(F.array_contains(choices, F.col(answer)), F.col(answer)))


def classified(rows: DataFrame, kinds: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """Rows with the columns of their kind (a constant dimension, keyed by ``name``); a name without kind raises an error, or
    without ``strict`` its rows go (``unmapped`` has them)."""
    if not strict:
        return rows.join(F.broadcast(kinds), name)
    joined = rows.join(F.broadcast(kinds.withColumn("_there", F.lit(True))), name, "left")
    known = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("unknown question name "), F.coalesce(name, F.lit("null"))))).otherwise(F.lit(True))
    return joined.where(known).drop("_there")


def unmapped(rows: DataFrame, kinds: DataFrame, name: str) -> DataFrame:
    """Names without a kind and how many rows have them."""
    return rows.join(F.broadcast(kinds.select(name)), name, "left_anti").groupBy(name).agg(F.count("*").alias("n"))


def weighted_mean(board: DataFrame, keys: list[str], metrics: list[str], weight: str) -> DataFrame:
    """Means of figures by a weight column; null where the weights are 0."""
    return board.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(weight).cast("double")).alias(m) for m in metrics])


def confusion(rows: DataFrame, keys: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """keys, truth, prediction, n; invalid predictions under null."""
    return rows.groupBy(*keys, truth, prediction).agg(F.count("*").alias("n"))


def class_counts(rows: DataFrame, keys: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """keys, class, tp, fp, fn, tn, support, for each class that occurs as truth or prediction within the keys."""
    n = confusion(rows, keys, truth, prediction)
    hit = F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0)
    sides = n.select(*keys, F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), hit.cast("long").alias("tp")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select(*keys, "s.*")
    # a row for each class; the null class holds the invalid predictions, which the total takes from the truth side alone
    by_class = sides.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("support", "named", "tp")])
    total = F.sum("support").over(Window.partitionBy(*keys))
    return (
        by_class.withColumn("_total", total)
        .where(F.col("class").isNotNull())
        .select(*keys, "class", "tp", (F.col("named") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), (F.col("_total") - F.col("support") - F.col("named") + F.col("tp")).alias("tn"), "support")
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, specificity, f1, f2, f05."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r, "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    return out.withColumns({name: f_beta(F.col("precision"), F.col("recall"), b) for name, b in (("f1", 1.0), ("f2", 2.0), ("f05", 0.5))})


METRICS = ("precision", "recall", "specificity", "f1", "f2", "f05")


def macro(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS], F.sum("support").alias("samples"))


def weighted(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means weighted by support; null without support."""
    return metrics.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support").cast("double")).alias(m) for m in METRICS])


def normalised(counts: DataFrame, by: str, keys: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Valid predictions' confusion as shares of the true class, of the predicted one, or of all (``by``: true, pred, all)."""
    part = {"true": [*keys, truth], "pred": [*keys, prediction], "all": keys}[by]
    valid = counts.where(F.col(prediction).isNotNull())
    return valid.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*part))))


def summary(rows: DataFrame, keys: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """total, valid, correct, valid_rate and accuracy."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count(prediction).alias("valid"), F.count_if(F.col(truth) == F.col(prediction)).alias("correct"))
    return out.withColumns({"valid_rate": ratio(F.col("valid"), F.col("total")), "accuracy": ratio(F.col("correct"), F.col("total"))})


def best_worst(metrics: DataFrame, keys: list[str], metric: str = "f1") -> DataFrame:
    """The classes of the highest and lowest figure; a tie goes to the first in the alphabet."""
    name = F.col("class")
    ranked = metrics.withColumn("_m", F.round(metric, 9))
    first = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order, name))
    both = ranked.withColumns({"_b": first(F.col("_m").desc()), "_w": first(F.col("_m").asc())})
    return both.groupBy(*keys).agg(
        F.max(F.when(F.col("_b") == 1, name)).alias("best_class"), F.max(F.when(F.col("_b") == 1, F.col(metric))).alias("best"),
        F.max(F.when(F.col("_w") == 1, name)).alias("worst_class"), F.max(F.when(F.col("_w") == 1, F.col(metric))).alias("worst"),
    )


def highlights(board: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Adds place: 1 and 2 for the best and second-best distinct figure; others go."""
    w = Window.partitionBy(*by).orderBy(F.round(metric, 9).desc())
    return board.withColumn("place", F.dense_rank().over(w)).where("place <= 2")


def min_max_scaled(board: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Adds scaled: 0 to 100 within the group; 50 where all are within 1e-6."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(metric).over(w), F.max(metric).over(w)
    return board.withColumn("scaled", F.when(hi - lo < 1e-6, F.lit(50.0)).otherwise(F.try_divide((F.col(metric) - lo) * 100, hi - lo)))


def pivoted(board: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """One row for each ``row``, a column for each of the named values; 0 for what is missing."""
    return board.groupBy(row).pivot(column, values).agg(F.avg(metric)).fillna(0.0)


def compared(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Two boards side by side where both have the keys, and the difference b - a."""
    left, right = a.select(*keys, F.col(metric).alias("single")), b.select(*keys, F.col(metric).alias("multi"))
    return left.join(right, keys).withColumn("delta", F.col("multi") - F.col("single"))


def failures(rows: DataFrame, keys: list[str], least: int, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Valid but wrong (truth, prediction) pairs that occur ``least`` times or more."""
    return confusion(rows.where(F.col(truth) != F.col(prediction)), keys, truth, prediction).where(F.col("n") >= least)


def model_failures(rows: DataFrame, model: str, top: int = 3, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """model, total, accuracy, rank, truth, prediction, n: the commonest valid but wrong pairs of each model, ties by name; a model without
    one has no row.  From one small table of counts."""
    counts = confusion(rows, [model], truth, prediction)
    hit = F.col(truth) == F.col(prediction)
    whole = counts.groupBy(model).agg(F.sum("n").alias("total"), ratio(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    order = Window.partitionBy(model).orderBy(F.col("n").desc(), truth, prediction)
    wrong = counts.where(~hit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return whole.join(wrong, model).select(model, "total", "accuracy", "rank", truth, prediction, "n")


def cross_model_failures(rows: DataFrame, question: str, model: str, models: int = 2, total: int = 3, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Failures that several models share: question, truth, prediction, n_models, n, score = n_models * n, by_model ('a:3,b:1').

    Counts by model come first, so the second aggregation gets a row for each model and pattern."""
    each = confusion(rows.where(F.col(truth) != F.col(prediction)), [question, model], truth, prediction)
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", model, F.col("n").cast("string")))), ",")
    out = each.groupBy(question, truth, prediction).agg(F.count("*").alias("n_models"), F.sum("n").alias("n"), shown.alias("by_model"))
    return out.where((F.col("n_models") >= models) & (F.col("n") >= total)).withColumn("score", F.col("n_models") * F.col("n"))


def matrix_figures(counts: DataFrame, keys: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Of valid predictions: total, accuracy, error_diversity = kinds of errors / (k (k - 1)), and the three selection scores."""
    valid = counts.where(F.col(prediction).isNotNull())
    sides = valid.select(*keys, F.explode(F.array(truth, prediction)).alias("c")).distinct().groupBy(*keys).agg(F.count("*").alias("k"))
    out = valid.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0)).alias("hits"), F.count_if(F.col(truth) != F.col(prediction)).alias("kinds")
    )
    out = (out.join(sides, keys) if keys else out.crossJoin(sides)).withColumns({"accuracy": ratio(F.col("hits"), F.col("total")), "error_diversity": ratio(F.col("kinds"), F.col("k") * (F.col("k") - 1))})
    a, d = F.col("accuracy"), F.col("error_diversity")
    return out.withColumns({"by_diversity": d * F.log(F.col("total") + 1.0), "by_performance": 1 - 2 * F.abs(a - 0.5), "by_error": (1 - a) * d}).drop("hits", "kinds")


def majority(votes: DataFrame, keys: list[str], choice: str, position: str) -> DataFrame:
    """The choice with most votes; a tie goes to the one listed first."""
    counts = votes.groupBy(*keys, choice).agg(F.count("*").alias("votes"), F.min(position).alias("_p"))
    return counts.groupBy(*keys).agg(F.max_by(choice, F.struct(F.col("votes"), -F.col("_p"))).alias(choice), F.max("votes").alias("votes"))


def latex(board: list[dict], columns: list[str], caption: str = "") -> str:
    """A small collected board as a LaTeX table: figures with one decimal, the best of a column bold, the second underlined."""
    def cell(c: str, v: object) -> str:
        if not isinstance(v, float):
            return str(v).replace("_", r"\_")
        ranked = sorted({round(r[c], 9) for r in board if isinstance(r[c], float)}, reverse=True)
        text = f"{v:.1f}"
        return rf"\textbf{{{text}}}" if round(v, 9) == ranked[0] else rf"\underline{{{text}}}" if len(ranked) > 1 and round(v, 9) == ranked[1] else text

    lines = [r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"]
    return "\n".join([*lines, *(" & ".join(cell(c, r[c]) for c in columns) + r" \\" for r in board), r"\end{tabular}", r"\end{table}"])


def failure_report(patterns: list[dict], accuracy: list[dict]) -> str:
    """Collected top patterns and accuracies as Markdown."""
    out = ["# Failure report", "", "## Accuracy", ""] + [f"- {r['model']}: {100 * r['accuracy']:.1f} % of {r['total']:,}" for r in accuracy]
    return "\n".join([*out, "", "## Shared failures", "", *[f"- {p['question']}: {p['truth']} taken for {p['prediction']} by {p['n_models']} models, {p['n']} times" for p in patterns], ""])
