"""Every query of the engine's own operators against its SQL, at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

from strandlog.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    r = sql.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    theirs = Counter(tuple(plain(row[cols.index(c)]) for c in order) for row in r.fetchall())
    assert mine == theirs


def test_plans_stay_native(spark):
    for name in ("live_state", "find_many", "patch_merge", "text_index", "segment_encode"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in QUERIES["live_state"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in QUERIES["scan_page_first"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_custkey)" in QUERIES["range_lookup"](spark, SF)._jdf.queryExecution().toString()
