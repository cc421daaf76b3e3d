"""Every query that SQL can express, against DuckDB, and the entry without the training-text package."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from glosswork.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert name in ORACLE_SQL
    told = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in told.description].index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in told.fetchall())


def test_entry_without_the_text_package():
    code = "import sys; sys.modules['glosswork.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'coverage_status' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_text_package():
    for f in (ROOT / "glosswork").rglob("*.py"):
        if "llm" not in f.parts:
            assert "glosswork.llm" not in f.read_text()
