"""From raw documents to token ids: toxicity, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import bpe, mixing, near_dedup, secrets, toxicity
from lanewise.llm.common import forget, settled, table
from lanewise.llm.queries import DOMAINS, WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a toxicity of 0.3 or more go; the model learns from the labelled ones that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs.select(*COLUMNS), model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group stays; links need 0.8 of their 5-word shingles."""
    return near_dedup.deduplicated(docs.select(*COLUMNS), size=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every span found is replaced by a mask; all documents stay."""
    return secrets.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: nine tenths of the tokens, split by the target weights; no document is used twice."""
    return mixing.mix(docs.select(*COLUMNS), DOMAINS, WEIGHTS, share=0.9, seed=7, max_epochs=1).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Learnt models and BPE can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, tidy: bool = False) -> DataFrame:
    """All stages.  ``tidy``: tables that this process has settled are removed as soon as the next stage's input is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
        if tidy:
            forget(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
