"""Each query of the engine against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rulewright import oracle, queries

DATA = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        return "" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flows_read_lines_once(spark, monkeypatch):
    """The regions of flows make events once, in a table, and no later plan goes back to the lines; lines aren't shuffled with people's names."""
    asked, lines = [], queries.order_lines
    monkeypatch.setattr(queries, "order_lines", lambda *a: asked.append(a) or lines(*a))
    plan = queries.diff_of_flows(spark, DATA)._jdf.queryExecution().toString()
    assert len(asked) == 1 and "l_shipdate" not in plan
    window = lines(spark, DATA)[0]._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1].split(":- Window")[-1]
    below = window[: window.index("c_custkey")] if "c_custkey" in window else window
    assert "l_shipdate" in below and "r_name" not in below
