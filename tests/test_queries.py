"""Each query that has SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from datebook.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    ours, theirs = rows_of(got.columns, got.collect()), rows_of(columns, expected.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
