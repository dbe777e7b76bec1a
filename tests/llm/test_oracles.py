"""Every query of the subpackage with SQL of its own against DuckDB, value for value."""

import glob
import os

import duckdb
import pytest

from verdigris.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    result = c.execute(oracles.ORACLES[name])
    names = [d[0] for d in result.description]
    frame = queries.QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(names)
    key = lambda t: [(x is None, str(x)) for x in t]
    assert sorted((tuple(r[n] for n in names) for r in frame.collect()), key=key) == sorted(result.fetchall(), key=key)
