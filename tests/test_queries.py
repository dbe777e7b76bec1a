"""Every registered query against its DuckDB twin, value for value."""

import glob
import os

import duckdb
import pytest

from verdigris import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def _norm(value):
    if isinstance(value, float):
        return round(value, 6)
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def _rows(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, sf_dir, duck, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    got = frame.collect()
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    assert _rows(got, frame.columns, order) == _rows(result.fetchall(), names, order)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_oracle_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    frame = e.entry(spark)
    assert frame.count() > 0
    assert frame.columns[0] == "rule_id"
    assert set(e.oracle_sql()) <= set(e.queries())
