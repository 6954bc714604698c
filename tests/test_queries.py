"""Registered queries against their SQL on the smallest data; all of them with ``ALL_QUERIES=1``."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a6_passage_binding", "w10_reusable_task", "k2_fold_updates", "x10_assemble_text", "e3_match_substring", "e5_match_keywords",
          "j6_parents_by_structure", "a18_latency_quantiles", "t12_toc_items", "c7_validate_clauses", "g2_convert_positions", "w6_number_clauses"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


def names():
    return sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


def test_every_query_is_callable_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
