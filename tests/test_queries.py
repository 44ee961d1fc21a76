"""Every query runs at the smallest scale, and has the rows of its SQL where there is one."""

import os

import duckdb
import pytest

from talkgrid import plans

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if v == v else "nan"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    order = sorted(range(len(found.columns)), key=found.columns.__getitem__)
    rows = sorted((tuple(normal(r[i]) for i in order) for r in found.collect()), key=repr)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    wanted = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert rows == sorted((tuple(normal(r[i]) for i in order) for r in wanted.fetchall()), key=repr)


def test_entry_has_sql_for_known_queries_only():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()
