"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, tmp_path, name):
    catalog.queries()[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db.execute(f"CREATE OR REPLACE TABLE want AS {catalog.oracle_sql()[name]}")
    want = {r[0]: r[1] for r in db.execute("DESCRIBE want").fetchall()}
    got = {r[0]: r[1] for r in db.execute(f"DESCRIBE SELECT * FROM '{tmp_path}/out/*.parquet'").fetchall()}
    assert got == want
    cols = ", ".join(f'"{c}"' for c in sorted(want))
    a, b = f"SELECT {cols} FROM want", f"SELECT {cols} FROM '{tmp_path}/out/*.parquet'"
    assert db.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall() == [(0,)]
    assert db.execute(f"SELECT count(*) FROM ({b} EXCEPT ALL {a})").fetchall() == [(0,)]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1
