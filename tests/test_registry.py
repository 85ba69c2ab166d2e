"""The registry: every SQL twin has its query, and both agree on the columns; the flagship equals its twin."""

import os

import duckdb
import pytest

import __spark_entry__
from tickwise.plans import registry, registry_checks, registry_intake

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
have = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def test_twins_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@have
@pytest.mark.parametrize("name", [*registry_checks.SQL, *registry_intake.SQL, "flagship", "sc2_score_events", "an8_corpus_patterns", "ex1_search_exercises", "ex5_recommend_fills", "ev15_benchmark_summary", "pb5_events_between", "an7_near_repeats", "ts1_label_issues", "ev2_evaluate", "pr7_difficulty", "pb6_position_at", "lb8_bar_labels", "tx3_unsupported_claims", "st1_monthly_spend"])
def test_query_equals_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.queries()[name](spark, DIR)
    want = con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda rows: sorted(tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


@have
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
