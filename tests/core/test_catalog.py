"""Every registered query against its SQL, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from sessionmill.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({catalog.ORACLES[name]})").fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", ["session_profile", "compressed_context", "path_owners", "kb_chains", "similar_items", "promotion_pairs", "index_documents", "ledger_upsert", "transcript_blocks"])
def test_plans_have_no_cross_joins_and_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def late_documents(tmp_path_factory):
    """Documents of ids about 79,700 to 79,949, among them those of the last item numbers, in a folder of their own."""
    folder = str(tmp_path_factory.mktemp("late"))
    duckdb.sql(f"COPY (SELECT * REPLACE (doc_id + 79700 AS doc_id, 'src' || doc_id % 3 AS source) FROM '{SF_DIR}/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["created_items", "items_after_creates"])
def test_creates_equal_their_sql_where_ids_run_out(spark, late_documents, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{late_documents}/documents.parquet'")
    df = catalog.QUERIES[name](spark, late_documents)
    names = ", ".join(df.columns)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted(con.sql(f"SELECT {names} FROM ({catalog.ORACLES[name]})").fetchall(), key=repr)
    assert got == want
    if name == "created_items":
        assert "id_exhausted" in {r.code for r in df.select("code").collect()}
