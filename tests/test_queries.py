"""Every query with SQL gives the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tarnfall import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("lineitem", "events", "documents", "pages", "conversations", "part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_rows(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(names) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == want


def test_logs_of_documents_with_long_ids(spark, tmp_path):
    """Ids of six digits and more make the secrets in the logs 24 characters and longer."""
    ids = [k * 10**n + 1 for n in (0, 4, 5, 6, 9, 17) for k in (1, 9)] + list(range(99_995, 100_005))
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["sarif_findings"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['sarif_findings']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert len(got.where("length(doc_id) > 5 and is_secret").collect()) > 2


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
