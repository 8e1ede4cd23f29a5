"""The correctness gate: every registered query vs its DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QS = E.queries()
OS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(OS) <= set(QS)


@pytest.mark.parametrize("name", sorted(QS))
def test_query(spark, con, name):
    r = compare(spark, name, QS[name], OS.get(name), SF, con)
    assert r["status"] in ("match", "rows-only"), r
    assert r["spark_rows"] > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"component", "col_pos", "record_id", "sigma", "eigenvalue", "v"}
