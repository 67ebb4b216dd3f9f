"""Queries that write whole tables with the library's sinks and give what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import table
from .registry import query

SPLIT = "CASE WHEN user_id % 10 < 8 THEN 'train' ELSE 'val' END"


def kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(SPLIT).alias("split"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer")
def entities_saved_and_loaded(spark, sf_dir):
    """Customers as nested JSON documents, by their schema."""
    place = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    path = tables.scratch(spark, "entities")
    tables.write_entities(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), place.alias("place"), F.col("c_acctbal").alias("balance")), path)
    found = tables.read_entities(spark, path, "id LONG, name STRING, place STRUCT<segment: STRING, nation: LONG>, balance DOUBLE", lines=True)
    return found.select("id", "name", "place.segment", "place.nation", "balance")


@query(f"SELECT event_id, user_id, event_type, {SPLIT} AS split FROM events")
def json_by_kind_and_split(spark, sf_dir):
    """Folders by kind and split, whose names come back as columns."""
    path = tables.scratch(spark, "by")
    tables.write_by(kinds(spark, sf_dir), path, "event_type", "split")
    return spark.read.schema("event_id LONG, user_id LONG, event_type STRING, split STRING").json(path)


@query(f"SELECT event_type, {SPLIT} AS split, CAST(1 AS BIGINT) AS files FROM events GROUP BY ALL")
def listed_files(spark, sf_dir):
    """Files found below a folder, as many as are expected: one for each kind and split."""
    path = tables.scratch(spark, "by")
    rows = kinds(spark, sf_dir)
    tables.write_by(rows.repartition("event_type", "split"), path, "event_type", "split")
    expected = rows.select("event_type", "split").distinct().count()
    part = lambda c: F.regexp_extract("path", rf"/{c}=([^/]+)/", 1).alias(c)
    return tables.expect_files(spark, path, "*.json", expected).groupBy(part("event_type"), part("split")).agg(F.count("*").alias("files"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, true AS bounded FROM events")
def files_of_bounded_rows(spark, sf_dir):
    """Rows in files of at most 700: how many there are, and whether a file holds more."""
    path = tables.scratch(spark, "batches")
    tables.write_batches(kinds(spark, sf_dir), path, 700)
    found = spark.read.schema("event_id LONG").json(path).select("event_id", F.col("_metadata.file_path").alias("file"))
    files = found.groupBy("file").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
    return files.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.max("n") <= 700).alias("bounded"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_exported(spark, sf_dir):
    path = tables.scratch(spark, "csv")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("mode", "FAILFAST").csv(path)


@query("SELECT p_name AS value FROM part WHERE p_partkey % 5 > 0")
def text_list(spark, sf_dir):
    """A list with blank lines and spaces around its values, which reading takes away."""
    path = tables.scratch(spark, "list")
    padded = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.lit("   "))
    tables.write_list(table(spark, sf_dir, "part").select(padded.alias("line")), "line", path)
    return tables.read_list(spark, path)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def resumed_table(spark, sf_dir):
    """A finished table is read, not made again."""
    path = tables.scratch(spark, "once")
    tables.once(spark, path, lambda: table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")))

    def again():
        raise AssertionError("made twice")

    return tables.once(spark, path, again)
