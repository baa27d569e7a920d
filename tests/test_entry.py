import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["topic_store", "topic_topn", "unit_matrix", "graph_spanning_forest", "plan_knapsack", "document_topics", "structured_round_trip", "breakdown_wide"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = entry.queries()[name](spark, SF)
    columns = sorted(mine.columns)
    other = con.sql(entry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    rows = other.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(repr([plain(v) for v in r]) for r in mine.select(columns).collect()) == sorted(repr([plain(v) for v in r]) for r in rows)
