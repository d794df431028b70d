import os

import pytest

import __spark_entry__
import corpus_pipeline as pipeline
from sessionmill.llm.session import stored
from tests.llm.test_near_dedup import brute

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF_DIR), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS and docs.dtypes == before.dtypes
    clean = [i for i, t in labels.items() if not t]
    stayed = {r.doc_id for r in kept["toxicity"].collect()}
    assert len([i for i in clean if i in stayed]) >= 0.95 * len(clean)
    rows = [(r.doc_id, r.text) for r in kept["toxicity"].collect()]
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == {i for i, (_, c) in brute(rows).items() if i == c}
    assert kept["personal_data"].count() == kept["near_duplicates"].count()
    assert not kept["personal_data"].where("text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count()
    mixed = kept["mixing"].select("doc_id").collect()
    assert 0 < len(mixed) == len({r.doc_id for r in mixed}) < kept["personal_data"].count()
    pieces = kept["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed} and max(r.offset + r.length for r in pieces) <= 4096


def test_rows_without_ids(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    df = spark.createDataFrame([(None, "same text here for all of us", "en", "src1", 5, 1), (None, "same text here for all of us", "en", "src1", 5, 1), (1, None, None, None, None, 1), (1, "", "en", "src2", 0, 1)], kind)
    out = pipeline.drop_near_duplicates(spark, df, SF_DIR)
    assert out.columns == pipeline.COLUMNS and out.count() == 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == pipeline.COLUMNS


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
