"""Every query that has SQL gives the same rows as that SQL in another engine."""

import glob
import os

import duckdb
import pytest

from lodestone import catalog

FOLDER = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, other, name):
    got = catalog.queries()[name](spark, FOLDER).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns
        return
    other.register("got", got)
    other.execute(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    shape = [sorted((r[0], r[1]) for r in other.execute(f"DESCRIBE {s}").fetchall()) for s in ("SELECT * FROM got", "want")]
    assert [c for c, _ in shape[0]] == [c for c, _ in shape[1]]
    columns = ", ".join(f'"{c}"' for c, _ in shape[0])
    for a, b in (("got", "want"), ("want", "got")):
        assert other.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
    other.unregister("got")
