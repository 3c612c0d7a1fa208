"""Every query with an equivalent runs on the smallest tables and equals DuckDB's answer."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the tables are not here")


def plain(rows, names):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "answer" in out.columns


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), names)


def test_queries_without_sql_run(spark):
    names = [n for n in entry.queries() if n not in entry.oracle_sql() and n.startswith("q_")]
    for name in names:
        assert entry.queries()[name](spark, SF).schema
