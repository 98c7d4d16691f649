"""The registry: every oracle belongs to a query, and a sample of queries agrees with DuckDB."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_names_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 140 and len(e.oracle_sql()) > 130"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, timeout=120).returncode == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["smart_filter", "dedup_lines", "handler_git_status", "handler_typescript", "summary_prose", "session_finalize", "burn_rate", "near_dup_documents", "fence_state", "signal_terms"])
def test_agrees(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = con.sql(e.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
