"""A sample of registered queries against their SQL twins on the smallest tables.

``python tests/check_queries.py 0.01`` compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of
from conftest import SF

SAMPLE = [
    "p4_normalize_url", "p13_normalize_item", "c1_classify", "f2_search", "w3_keyset_page", "a3_source_balance",
    "a7_weekly_candidates", "d1_duplicate_lookup", "d2_greedy_first_wins", "j1_candidate_window", "j2_similar_articles",
    "g10_story_graph", "u7_replace_relationships", "s1_feed_items",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
