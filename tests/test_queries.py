"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB row by row."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def rows(table):
    cols = sorted(table.column_names)

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return Counter(tuple(plain(r[c]) for c in cols) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_against_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toArrow()
    want = duck.execute(ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
