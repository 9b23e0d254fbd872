"""The driver contract: every query and its SQL, side by side on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quoin.plans.registry import ORACLES, QUERIES

FOLDER = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(rows):
    fix = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    if name in ORACLES:
        assert got == plain(duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "item_id"] and set(entry.oracle_sql()) <= set(entry.queries())
