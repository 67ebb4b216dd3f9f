"""The registered queries: SQL where there is some, and the columns that each promises."""

import glob
import os

import duckdb
import pytest

from lanewise.llm import queries

COLUMNS = {
    "op2_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_": ["doc_id", "held_out", "score", "predicted"],
    "op5_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op9_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11_": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op13_": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(name, spark, duck, small):
    df = queries.queries()[name](spark, small)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want.select(*df.columns).fetchall()))


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns(start, spark, small):
    name = next(n for n in queries.queries() if n.startswith(start))
    df = queries.queries()[name](spark, small)
    assert df.columns[: len(COLUMNS[start])] == COLUMNS[start]
    assert df.count() == spark.read.parquet(f"{small}/{'embeddings' if start == 'op13_' else 'documents'}.parquet").count()


def test_native_operators_have_no_python(spark, small):
    for start in ("op2_", "op3_", "op8_"):
        name = next(n for n in queries.queries() if n.startswith(start))
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
