"""The operators' queries that SQL can express, on the smallest tables; and that every query is registered."""

from pathlib import Path

import duckdb
import pytest

from rulewright.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want, got = con.sql(queries.SQL[name]).df(), queries.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 14)} and "pipeline" in names
