"""Every registered query against its SQL in DuckDB on the smallest tables."""
import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from slotworks.plans import catalog

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
ROWS_ONLY = {"p11_schema_contract", "a25_covariance_spectrum", "m02_ridge_fit", "m04_soft_logistic_fit",
             "m05_attention_score", "m09_train_eval_report"}


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_only_the_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], ROOT) == []


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, ROOT)
    assert df.collect() and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["label"] for r in rows} == {"quality", "toxic", "english", "MEAN"}
