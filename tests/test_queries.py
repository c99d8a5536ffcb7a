"""Every core query against its SQL in DuckDB, on the smallest tables; those without SQL must give rows."""

import os
from decimal import Decimal

import duckdb
import pytest

from ferrolens.plans.catalogue import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    return None if isinstance(x, float) and x != x else x


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    assert table_of(df.columns, rows) == table_of(want.columns, want.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry module works where the corpus operators are missing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "ferrolens", tmp_path / "ferrolens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = (
        "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()\n"
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.warehouse.dir', {str(tmp_path / 'w')!r}).getOrCreate()\n"
        f"assert all(q[n](s, {FOLDER!r}).count() for n in ('fus4_diagnose', 'ts3_ema', 'doc6_chunk_documents'))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
