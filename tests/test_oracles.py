"""Every query runs and keeps its schema; where SQL can express it, DuckDB gives the same rows over the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quirelake.plans import ORACLES, QUERIES


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return None if v is None or v != v else v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    frame = got.toPandas()
    assert list(frame.columns) == got.columns
    if name not in ORACLES:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLES[name]).df()
    assert sorted(want.columns) == sorted(frame.columns)
    assert rows(frame, sorted(frame.columns)) == rows(want, sorted(frame.columns))


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "total", "done", "failed", "complete"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
