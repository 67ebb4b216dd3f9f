"""Documents for the operators' tests: driver rows, and rows for every odd case."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "née", "straße", "日本"]
    para = " ".join(rng.choice(words) for _ in range(200))
    rows = [
        (10_000, None, None, None, None),
        (10_001, "", "en", "s", 0),
        (10_002, " \t\n ", None, "s", 4),
        (10_003, "one", "en", None, 3),
        (10_004, "One", "en", "s", 3),
        (10_005, "one two", "en", "s", 7),
        (10_006, "ONE\ttwo", "xx", "s", 7),
        (10_007, para, "en", "s", len(para)),
        (10_007, para, "en", "s", len(para)),
        (10_008, para + " tail", "en", "s", len(para) + 5),
        (10_009, para[: len(para) // 2] + "XYZ" + para[len(para) // 2 :], "en", "s", len(para) + 3),
        (10_010, "x" * 3000, "en", "s", 3000),
        (10_011, "ab" * 1500, "en", "s", 3000),
        (10_012, "é😀 " * 400 + "password = 'abcdefGHIJ0123456789'", "fr", "s", 1233),
        (10_013, "word " * 30_000, "en", "s", 150_000),
        (None, "no id at all", "en", "s", 12),
    ]
    return rows


def documents(spark, folder="/root/testdata/sf0.001"):
    real = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return real.union(spark.createDataFrame(odd_rows(), SCHEMA))


def with_clashing_columns(df):
    """The same table with columns named as those that operators make for themselves."""
    names = ["score", "kept", "fp", "th", "spans", "n", "hub", "key", "bucket", "words", "component_id", "mix_tokens", "n_hex", "base_spans"]
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
