"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lanewise.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x.isoformat() if hasattr(x, "isoformat") else x
    return sorted(tuple(repr(plain(x)) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, small):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["topk_hit_rate", "pr_curve", "average_precision"])
def test_images_of_over_1000_boxes(name, spark, small, tmp_path):
    con = duckdb.connect()
    lines = f"select * replace (case when l_orderkey % 3 = 0 then 1 else l_orderkey + 1 end as l_orderkey) from '{small}/lineitem.parquet'"
    con.execute(f"copy ({lines}) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert con.sql("select count(*) from lineitem where l_orderkey = 1").fetchall()[0][0] > 1000
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(SQL[name]).df())
