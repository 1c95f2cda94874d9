"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck, types_of

SF = "/root/testdata/sf0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(5).count() == 5


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
        return
    rel = con.sql(sql)
    assert types_of(df, rel) == ""
    assert compare(got, rel.df()) == "ok"


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert out.returncode == 0 and int(out.stdout.split()[-2]) == len(NAMES)


def test_oracle_sql_is_text():
    assert [name for name, sql in entry.oracle_sql().items() if not isinstance(sql, str)] == []
