"""Mixing sources to target weights: budgets down a tree of domain, language and source, then a prefix of tokens of each leaf.

*Budgets*.  A budget of tokens is split among a node's children by their weights.  A child can give at most its supply times
``max_epochs``; what it falls short of goes to its siblings by weight, again and again until all are full or the budget is
spent, and only what the siblings cannot take is left over for the node's parent, which hands it to the node's own siblings.
As a node's capacity is the sum of its leaves', splitting capped budgets from the root down does exactly that.  The tree has
one row for each domain, language and source; it is as large as the target's own description and is worked on by the driver.

*Selection*.  In each epoch a leaf's documents come in the order of a hash of (seed, epoch, doc_id).  Full epochs take all of them;
the last one takes the documents that begin within the rest of the budget.  The cut is found without sorting a leaf: tokens
are summed by leaf and the leading 16 bits of the hash; running sums, first over 256 coarse slices and then over the 256 fine
ones of the slice that holds the cut, find the fine one, and only its documents are sorted.  A leaf with a third of all rows
is thus spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

LEVELS = ("domain", "lang", "source")
#: Leaves up to which their plan is broadcast; more of them are joined by a shuffle.
BROADCAST_LEAVES = 50_000
NO_VALUE = ""


def split(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its room; what is short goes to the others by weight."""
    got, active = [0.0] * len(weights), [i for i, (w, r) in enumerate(zip(weights, room, strict=True)) if w > 0 and r > 0]
    left = budget
    while active and left > 1e-9:
        total = sum(weights[i] for i in active)
        full = [i for i in active if room[i] <= left * weights[i] / total]
        if not full:
            for i in active:
                got[i] = left * weights[i] / total
            return got
        for i in full:
            got[i] = room[i]
        left -= sum(room[i] for i in full)
        active = [i for i in active if i not in full]
    return got


def budgets(supply: Mapping[tuple[str, str, str], int], budget: float, weights: Mapping[tuple[str, ...], float], max_epochs: int) -> dict[tuple[str, str, str], int]:
    """Tokens for each leaf.  ``weights``: by path from the root, of any length up to 3; 1 for paths not named."""
    out: dict[tuple[str, str, str], int] = {}
    room: dict[tuple[str, ...], float] = {(): 0.0}
    below: dict[tuple[str, ...], set] = {}
    for leaf, n in supply.items():
        for k in range(len(leaf) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0.0) + max_epochs * n
            if k < len(leaf):
                below.setdefault(leaf[:k], set()).add(leaf[: k + 1])

    def down(path: tuple[str, ...], amount: float) -> None:
        if len(path) == len(LEVELS):
            out[path] = round(amount)
            return
        children = sorted(below.get(path, ()))
        for child, share in zip(children, split(amount, [weights.get(c, 1.0) for c in children], [room[c] for c in children]), strict=True):
            down(child, share)

    down((), min(budget, room[()]))
    return out


def domain_of(source: Column, domains: Mapping[str, str], other: str = "web") -> Column:
    """The domain of a source by a table; ``other`` for sources not named."""
    pairs = [F.lit(x) for pair in domains.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(other)) if pairs else F.lit(other)


def n_tokens(text: Column) -> Column:
    """Tokens for the budget: words of the text, at least 1 so that every document counts."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def mix(docs: DataFrame, domains: Mapping[str, str], weights: Mapping[tuple[str, ...], float], share: float = 0.5, seed: int = 7, max_epochs: int = 2) -> DataFrame:
    """Rows of docs with mix_domain, mix_tokens, mix_epochs (how often the row is used, 1 or more) and mix_budget (of its leaf).

    ``share``: budget as a share of all tokens of docs.  Rows that aren't used are left out.  A null lang or source is a leaf of
    its own, named by the empty text; a null text counts as one token.  Rows that repeat a doc_id follow one another by a hash
    of the text, so repeated rows fall on the same side unless the cut is between them; then the earlier one is used.
    Columns of docs stay as they are; those whose names begin with mix_ are replaced.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE))
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    marked = docs.withColumns({"mix_domain": domain_of(name("source"), domains), "mix_lang": name("lang"), "mix_source": name("source"), "mix_tokens": n_tokens(F.col("text"))})
    leaf = ["mix_domain", "mix_lang", "mix_source"]
    supply = {(r[0], r[1], r[2]): r[3] for r in marked.groupBy(*leaf).agg(F.sum("mix_tokens")).collect()}
    if not supply:
        return marked.withColumns({"mix_epochs": F.lit(1), "mix_budget": F.lit(0).cast("long")}).drop("mix_lang", "mix_source")
    plan = budgets(supply, share * sum(supply.values()), weights, max_epochs)
    spark = docs.sparkSession
    # whole epochs, then what the last one takes
    rows = [(*k, b, b // supply[k], b % supply[k]) for k, b in plan.items()]
    small = F.broadcast if len(rows) <= BROADCAST_LEAVES else (lambda df: df)
    named = "mix_domain string, mix_lang string, mix_source string, "
    leaves = spark.createDataFrame(rows, named + "mix_budget long, mix_whole long, mix_rest long")
    hashed = F.xxhash64(F.lit(seed), F.col("mix_whole"), F.col("doc_id").cast("long"))
    dealt = marked.join(small(leaves), leaf).withColumns({"mix_hash": hashed, "mix_slice": F.shiftright(hashed, 48).cast("int")})
    fine = settled(dealt.groupBy(*leaf, "mix_slice").agg(F.sum("mix_tokens").alias("n"), F.first("mix_rest").alias("rest")).withColumn("coarse", F.shiftright("mix_slice", 8)))
    so_far = lambda order: F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy(*leaf, "coarse").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("before", so_far("coarse"))
    coarse_cut = coarse.where("before < rest and before + n >= rest").select(*leaf, "coarse", F.col("before").alias("base"))
    cuts = fine.join(small(coarse_cut), [*leaf, "coarse"]).withColumn("before", F.col("base") + so_far("mix_slice")).where("before < rest and before + n >= rest")
    # one row for each leaf with a rest
    found = {(r[0], r[1], r[2]): (r[3], r[4]) for r in cuts.select(*leaf, "mix_slice", "before").collect()}
    cut_rows = [(*k, *found.get(k, (-(1 << 30), 0))) for k in plan]
    known = dealt.join(small(spark.createDataFrame(cut_rows, named + "mix_cut int, mix_before long")), leaf)
    # the slice with the cut is sorted; the others only look at their slice
    columns = known.columns
    inside = known.where("mix_slice = mix_cut").withColumn("mix_order", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    running = Window.partitionBy(*leaf).orderBy("mix_hash", "doc_id", "mix_order").rowsBetween(Window.unboundedPreceding, -1)
    sorted_slice = inside.withColumn("mix_extra", (F.col("mix_before") + F.coalesce(F.sum("mix_tokens").over(running), F.lit(0)) < F.col("mix_rest")).cast("long"))
    others = known.where("mix_slice <> mix_cut").withColumn("mix_extra", (F.col("mix_slice") < F.col("mix_cut")).cast("long"))
    used = others.select(*columns, "mix_extra").union(sorted_slice.select(*columns, "mix_extra")).withColumn("mix_epochs", (F.col("mix_whole") + F.col("mix_extra")).cast("int"))
    return used.where("mix_epochs > 0").select(*docs.columns, "mix_domain", "mix_tokens", "mix_epochs", "mix_budget")


def report(docs: DataFrame, domains: Mapping[str, str], weights: Mapping[tuple[str, ...], float], share: float = 0.5, seed: int = 7, max_epochs: int = 2) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs, leaf_budget of the rows that are used."""
    mixed = mix(docs.select("doc_id", "text", "lang", "source"), domains, weights, share, seed, max_epochs)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epochs").alias("epochs"), F.col("mix_budget").alias("leaf_budget"))
