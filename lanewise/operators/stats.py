"""Statistics of a data set in one pass each: grouping sets, rollups with shares, zero-filled hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_dimension(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n: counts by each dimension for itself.  Rows are unpivoted to partial counts, shuffled once."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def hierarchy(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of a rollup, its depth, and the share of the parent's count.  Levels must not be null."""
    out = rows.rollup(*levels).agg(F.count("*").alias("n"), (F.lit(len(levels)) - F.bit_count(F.grouping_id())).cast("int").alias("depth"))
    parent = [F.when(F.col("depth") > i + 1, F.col(c)) for i, c in enumerate(levels[:-1])]
    # a parent's count is the sum of its children's
    total = F.sum("n").over(Window.partitionBy("depth", *parent))
    return out.withColumn("share", F.when(F.col("depth") == 0, F.lit(1.0)).otherwise(F.col("n") / total))


def zero_filled(counts: DataFrame, dimension: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """A row for each row of the dimension, with 0 where nothing was counted."""
    return dimension.join(counts, keys, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))


def first_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in their order; of rows with the same key the first table's stays (within a table the least row)."""
    out = None
    for i, t in enumerate(tables):
        part = t.withColumn("_order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    columns = tables[0].columns
    return out.groupBy(key).agg(F.min(F.struct("_order", *[c for c in columns if c != key])).alias("_m")).select(*[key if c == key else F.col(f"_m.{c}").alias(c) for c in columns])
