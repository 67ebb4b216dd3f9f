"""Sampling and balancing.  Random choices are ranks of an md5 of a seed and the row's key: the same rows in any partitioning,
on any engine, in any run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))


def sample(rows: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """n rows by the least md5: a top-n of every partition, then of these."""
    return rows.orderBy(draw(seed, *keys), *keys).limit(n)


SLICE = 3


def running(rows: DataFrame, groups: list[str], amount: Column, seed: str, *keys: str) -> DataFrame:
    """Adds _before: the sum of ``amount`` over the rows of the group that come earlier by md5.

    Groups are cut into 4096 slices by the first digits of the md5.  Sums of slices, at most 4096 rows of each group, are added up
    first; rows are then sorted within their slice only.  A group with most of all rows is spread like any other."""
    marked = rows.withColumns({"_draw": draw(seed, *keys), "_amount": amount}).withColumn("_slice", F.substring("_draw", 1, SLICE))
    sums = marked.groupBy(*groups, "_slice").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*groups, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*groups, "_slice").orderBy("_draw", *keys).rowsBetween(Window.unboundedPreceding, -1)
    # null groups are groups, too
    on = [F.col(f"_m.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in groups] + [F.col("_m._slice") == F.col("_b._slice")]
    joined = marked.alias("_m").join(base.alias("_b"), on).select("_m.*", "_base")
    return joined.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_draw", "_amount", "_slice", "_base")


def shuffled(rows: DataFrame, seed: str, *keys: str, position: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in a random order of all rows, without a sort of all rows in one task.  Rows that are to be written
    in this order are sorted by the place; ``keys`` tell all rows apart."""
    return running(rows, [], F.lit(1).cast("long"), seed, *keys).withColumnRenamed("_before", position)


def stratified(rows: DataFrame, by: list[str], n: int | Column, seed: str, *keys: str) -> DataFrame:
    """Up to n rows (a number or a column) of each stratum.

    For a number the planner keeps the first n of each stratum in every task before rows are shuffled; a column goes by ``running``."""
    if isinstance(n, int):
        w = Window.partitionBy(*by).orderBy(draw(seed, *keys), *keys)
        return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
    return running(rows, by, F.lit(1).cast("long"), seed, *keys).where(F.col("_before") < n).drop("_before")


def split_by_count(rows: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """Adds split: 'train' for n rows by md5, 'val' for the others.  The n-th md5 is found by a top-n, nothing is sorted whole."""
    last = rows.select(draw(seed, *keys).alias("d")).orderBy("d").limit(n).agg(F.max("d")).first()[0]
    return rows.withColumn("split", F.when(draw(seed, *keys) <= F.lit(last), "train").otherwise("val"))


def split_by_share(rows: DataFrame, share: float, seed: str, *keys: str) -> DataFrame:
    """Adds split by the leading 28 bits of the md5: 'train' for about that share.  One pass, no shuffle."""
    part = F.conv(F.substring(draw(seed, *keys), 1, 7), 16, 10).cast("long")
    return rows.withColumn("split", F.when(part < F.lit(int(share * (1 << 28))), "train").otherwise("val"))


def early_stop(counts: DataFrame, key: str, n: str, target: float, seed: str) -> DataFrame:
    """Scenes in md5 order until their samples reach 1.5 times the target; counts has one row for each scene."""
    return running(counts, [], F.col(n), seed, key).withColumnRenamed("_before", "before").where(F.col("before") < 1.5 * target)


def negatives(observed: DataFrame, universe: DataFrame, groups: list[str], keys: list[str], seed: str, ratio: float = 0.5) -> DataFrame:
    """For each group as many keys that weren't observed, by md5, as make up the ratio.

    The universe is a dimension of fixed size; its rows are exploded as a literal for each group, and the anti join is on all keys."""
    seen = observed.select(*groups, *keys).distinct()
    wanted = seen.groupBy(*groups).agg(F.floor(F.count("*") * ratio / (1 - ratio)).alias("_wanted"))
    kinds = dict(universe.dtypes)
    every = F.array(*[F.struct(*[F.lit(r[k]).cast(kinds[k]).alias(k) for k in keys]) for r in universe.select(*keys).distinct().collect()])
    free = wanted.select("*", F.explode(every).alias("_u")).select(*groups, "_wanted", "_u.*").join(seen, [*groups, *keys], "left_anti")
    w = Window.partitionBy(*groups).orderBy(draw(seed, *groups, *keys), *keys)
    return free.withColumn("_rank", F.row_number().over(w)).where("_rank <= _wanted").select(*groups, *keys)


def fewer_choices(choices: Column, answer: Column, n: int, seed: str, key: Column) -> Column:
    """The answer and n - 1 other choices, both drawn and ordered by md5; the choices themselves if they are n or fewer."""
    ranked = lambda tag, arr: F.transform(F.array_sort(F.transform(arr, lambda c: F.struct(draw(seed + tag, key, c).alias("d"), c.alias("c")))), lambda x: x["c"])
    others = F.slice(ranked("d", F.filter(choices, lambda c: c != answer)), 1, n - 1)
    return F.when(F.size(choices) > n, ranked("o", F.array_append(others, answer))).otherwise(choices)


def pick(options: Column, seed: str, key: Column) -> Column:
    """One element by md5."""
    return F.element_at(options, (F.pmod(F.conv(F.substring(draw(seed, key), 1, 7), 16, 10).cast("long"), F.size(options).cast("long")) + 1).cast("int"))


def balance_metrics(counts: DataFrame, groups: list[str], n: str = "n") -> DataFrame:
    """Of counts by group and answer: total, choices, min, max, dominant_ratio, entropy, effective answers, balance_score."""
    total = counts.groupBy(*groups).agg(F.sum(n).alias("_total")) if groups else counts.agg(F.sum(n).alias("_total"))
    both = counts.join(total, groups) if groups else counts.crossJoin(total)
    p = F.col(n) / F.col("_total")
    out = both.groupBy(*groups).agg(
        F.sum(n).alias("total"),
        F.count("*").alias("num_choices"),
        F.min(n).alias("min_count"),
        F.max(n).alias("max_count"),
        (F.max(n) / F.sum(n)).alias("dominant_ratio"),
        F.sum(F.when(F.col(n) > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"),
    )
    return out.withColumn("effective_answers", F.exp("entropy")).withColumn("balance_score", F.col("effective_answers") / F.col("num_choices"))


def should_balance(score: Column, dominant: Column, least: Column, k: Column) -> Column:
    return (F.round(score, 9) <= 0.7) & ((F.round(dominant, 9) > 0.6) | ((least < 2) & (k > 2)))


def answer_targets(counts: DataFrame, groups: list[str], target: int | Column, n: str = "n") -> DataFrame:
    """Adds target: share of the total by the square root of the count, at least max(2, target / 4k), scaled down if too many."""
    w = Window.partitionBy(*groups)
    goal = F.lit(target) if isinstance(target, int) else target
    root = F.sqrt(F.col(n).cast("double"))
    share = F.greatest(F.lit(1), F.floor(F.round(goal * root / F.sum(root).over(w), 9)))
    least = F.greatest(F.lit(2), F.floor(goal / (F.count("*").over(w) * 4)))
    planned = counts.withColumn("_planned", F.greatest(least, share))
    total = F.sum("_planned").over(w)
    scaled = F.when(total > goal, F.greatest(F.lit(1), F.floor(F.round(F.col("_planned") * goal / total, 9)))).otherwise(F.col("_planned"))
    return planned.withColumn("target", F.least(scaled, F.col(n)).cast("long")).drop("_planned")


def balanced(samples: DataFrame, groups: list[str], answer: str, target: int, seed: str, *keys: str) -> DataFrame:
    """Balances answers within groups where they need it, and samples ``target`` rows of the others.  Null answers go.

    Counts and targets are joined back by group and answer, so the decision is a column and no branch runs on the driver."""
    rows = samples.where(F.col(answer).isNotNull())
    counts = rows.groupBy(*groups, answer).agg(F.count("*").alias("n"))
    decided = balance_metrics(counts, groups).select(*groups, ((F.col("num_choices") > 1) & should_balance(F.col("balance_score"), F.col("dominant_ratio"), F.col("min_count"), F.col("num_choices"))).alias("_balance"))
    goals = answer_targets(counts, groups, target).join(decided, groups).select(*groups, answer, "target", "_balance")
    known = rows.join(goals, [*groups, answer])
    taken = stratified(known.where("_balance"), [*groups, answer], F.col("target"), seed, *keys)
    rest = stratified(known.where("not _balance"), groups, target, seed, *keys)
    return taken.select(*samples.columns).union(rest.select(*samples.columns))


def capped_scenes(samples: DataFrame, scene: str, seed: str, *keys: str, threshold: float = 0.1) -> DataFrame:
    """Where one scene holds over half of the samples or the balance is below the threshold, at most twice the mean of each scene.

    Samples without a scene stay."""
    some = samples.where(F.col(scene).isNotNull())
    counts = some.groupBy(scene).agg(F.count("*").alias("n"))
    m = balance_metrics(counts, []).select((F.floor(2 * F.col("total") / F.col("num_choices"))).alias("cap"), ((F.round("dominant_ratio", 9) > 0.5) | (F.round("balance_score", 9) < threshold)).alias("uneven")).first()
    if not m or not m.uneven:
        return samples
    return stratified(some, [scene], int(m.cap), seed, *keys).unionByName(samples.where(F.col(scene).isNull()))


def ratio_balanced(rows: DataFrame, flag: str, seed: str, *keys: str, groups: list[str] | None = None) -> DataFrame:
    """As many rows with the flag as without, by md5, within each group."""
    groups = groups or []
    sizes = rows.groupBy(*groups).agg(F.least(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).alias("_n"))
    known = rows.join(sizes, groups) if groups else rows.crossJoin(sizes)
    return stratified(known, [*groups, flag], F.col("_n"), seed, *keys).drop("_n")
