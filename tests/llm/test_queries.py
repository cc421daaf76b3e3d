"""The registered queries: against DuckDB where SQL can express them, and the pipeline's stages one after another."""

import glob
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosswork.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = con.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in told.description) == columns
    at = [[d[0] for d in told.description].index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in told.fetchall())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(texts[name]) <= before
    assert len(texts["language_id"]) > 0.95 * len(ids)
    near, cut, clean = (texts[n] for n in ("ngram_jaccard_join", "suffix_dedup", "secret_scans"))
    assert set(near) < set(texts["language_id"]) and set(cut) == set(near) == set(clean)
    assert any(len(cut[i]) < len(near[i]) for i in near) and all(len(cut[i]) <= len(near[i]) for i in near)
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(clean)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
