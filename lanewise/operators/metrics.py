"""Metrics as row functions paired with mergeable aggregates, found by name.

A metric adds columns to each row and says which sums and counts of them it needs; its figures follow from those alone.  So any number
of metrics is worked out for any keys in one pass with partial aggregation, and figures of parts can be added up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import iou


@dataclass(frozen=True)
class Metric:
    """name; needs: columns that rows must have; rows: what each row gets; sums: what is added up of it; figures: of the sums.

    All columns and sums are named within the metric, so that metrics don't get in each other's way."""

    name: str
    needs: tuple[str, ...]
    rows: Callable[[], dict[str, Column]]
    sums: Callable[[Callable[[str], Column]], dict[str, Column]]
    figures: Callable[[Callable[[str], Column]], dict[str, Column]]


METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    if metric.name in METRICS:
        raise ValueError(f"there is a metric {metric.name} already")
    METRICS[metric.name] = metric
    return metric


def get(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"no metric {name}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]


def _within(name: str) -> Callable[[str], Column]:
    return lambda column: F.col(f"{name}_{column}")


def scored(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with the columns of each metric, as name_column."""
    out = rows
    for m in map(get, names):
        if missing := [c for c in m.needs if c not in rows.columns]:
            raise ValueError(f"{m.name} needs the columns {', '.join(missing)}")
        out = out.withColumns({f"{m.name}_{c}": v for c, v in m.rows().items()})
    return out


def sums(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The sums of all metrics by keys, in one aggregation."""
    each = {f"{m.name}_{c}": v for m in map(get, names) for c, v in m.sums(_within(m.name)).items()}
    return scored(rows, names).groupBy(*keys).agg(*[v.alias(c) for c, v in each.items()])


def added(parts: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Sums of parts, or of finer keys, added up."""
    columns = [f"{m.name}_{c}" for m in map(get, names) for c in m.sums(_within(m.name))]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def figures(parts: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    each = {f"{m.name}_{c}": v for m in map(get, names) for c, v in m.figures(_within(m.name)).items()}
    return parts.select(*keys, *[v.alias(c) for c, v in each.items()])


def evaluated(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Figures of the named metrics by keys."""
    return figures(sums(rows, names, keys), names, keys)


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where there is nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _choice() -> dict[str, Column]:
    valid = F.coalesce(F.array_contains("choices", F.col("prediction")), F.lit(False))
    return {"valid": valid, "correct": valid & F.coalesce(F.col("prediction") == F.col("truth"), F.lit(False))}


def _similarity() -> dict[str, Column]:
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in ("prediction", "truth"))
    return {"exact": F.coalesce(F.col("prediction") == F.col("truth"), F.lit(False)), "jaccard": tx.jaccard(tx.tokens(a), tx.tokens(b)), "f1": tx.token_f1_set(a, b)["f1"]}


register(
    Metric(
        "multiple_choice", ("prediction", "truth", "choices"), _choice,
        lambda c: {"n": F.count("*"), "valid": F.count_if(c("valid")), "correct": F.count_if(c("correct"))},
        lambda c: {"n": c("n"), "accuracy": share(c("correct"), c("n")), "valid_share": share(c("valid"), c("n"))},
    )
)
register(
    Metric(
        "text_similarity", ("prediction", "truth"), _similarity,
        lambda c: {"n": F.count("*"), "exact": F.count_if(c("exact")), "jaccard": F.sum(c("jaccard")), "f1": F.sum(c("f1"))},
        lambda c: {"n": c("n"), "exact": share(c("exact"), c("n")), "jaccard": share(c("jaccard"), c("n")), "f1": share(c("f1"), c("n"))},
    )
)
register(
    Metric(
        "box_overlap", ("prediction_box", "truth_box"),
        lambda: {"iou": iou([F.col("prediction_box")[i] for i in range(4)], [F.col("truth_box")[i] for i in range(4)])},
        lambda c: {"n": F.count("*"), "iou": F.sum(c("iou")), "hits": F.count_if(F.round(c("iou"), 9) >= 0.5)},
        lambda c: {"n": c("n"), "mean_iou": share(c("iou"), c("n")), "hit_share": share(c("hits"), c("n"))},
    )
)
