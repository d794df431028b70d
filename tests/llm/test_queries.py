"""The queries of this folder against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sessionmill.llm import queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


def plain(value):
    return (None if math.isnan(value) else float(f"{value:.9g}")) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({queries.ORACLES[name]})").fetchall()), key=repr) and got
