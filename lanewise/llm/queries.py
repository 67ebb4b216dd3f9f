"""The registered query of each operator: thin functions of (spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .common import table
from .language import identify
from .near_dedup import near_duplicates
from .codes import compressed
from .passages import without_passages
from .periods import with_runs
from . import fingerprints, mixing, oracles, quality, rules, secrets
from .repeats import without_repeats
from .toxicity import toxicity


#: The tree of the mixing query: domains of sources, and weights by path; sources not named are of the domain "web".
DOMAINS = {f"src{i}": ("books", "reference", "forum")[i % 3] for i in range(10, 22)}
WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("reference",): 2.0, ("forum",): 1.0, **{(d, lang): w for d in ("web", "books", "reference", "forum") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), DOMAINS, WEIGHTS, share=0.6, seed=7, max_epochs=2)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assessed(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80, k=128)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for bad quality, 1 for good quality that is toxic, 2 for the others; kept from grade 1 on."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return quality.grade(docs, quality.fit(docs, labels, graded), cut=1, least=0.5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), per_language=1500)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"), k=64)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), length=400, k=64, keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def with_periods(docs: DataFrame) -> DataFrame:
    """docs, in which the texts of one id in ten become periodic from some word on: h = crc32(id), word i >= a becomes word
    a + (i - a) % p.  Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    word = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, word).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("w")
    cut = split.select("doc_id", "text", "w", "g", F.when(n > 0, (F.col("g") % n).cast("int")).alias("a"))
    rest = F.size("w") - F.col("a")
    cut = cut.select("*", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return cut.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(with_periods(table(spark, sf_dir, "documents")), least=12, keep_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents"), length=13, k=5, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compressed(table(spark, sf_dir, "embeddings"), parts=4, entries=256, scale=1024, rounds=4)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dedup": oracles.NEAR_DEDUP, "op10_suffix_array_dedup": oracles.REPEATS, "op11_periodic_runs": oracles.RUNS, "op12_substring_dedup": oracles.PASSAGES, "op13_vector_codes": oracles.CODES}
