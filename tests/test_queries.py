"""Every registered query against its SQL twin (DuckDB) at sf0.001, and the
entry point. The driver runs the same comparison at sf0.01."""
import duckdb
import pytest

import __spark_entry__ as E
from codecorpus.plans import registry
from codecorpus.sources.tables import TABLES
from oracle_compare import digest

SF = "/root/testdata/sf0.001"
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[0] == "opt" and len(rows) == 4


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql()[name]  # every query here has a twin
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for c, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, duck_types[c]) == duck_types[c], (c, t, duck_types[c])
