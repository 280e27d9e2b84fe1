"""The registry: every SQL belongs to a query, and queries equal their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHEAP = ("transcode_segments", "word_units", "spatial_best_match", "quality_by_page", "alphabet_stats", "p2_found")


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
