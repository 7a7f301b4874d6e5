"""Every registered query equals its DuckDB oracle SQL (rows, names, types, values)."""

import pytest

import __spark_entry__ as entry_mod
from churnlens.plans import catalog
from tests.conftest import SF001, SF01
from tests.harness import compare, duck

QUERIES = {k: v for k, v in entry_mod.queries().items() if k in catalog.queries()}
ORACLE = {k: v for k, v in entry_mod.oracle_sql().items() if k in QUERIES}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def con01():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_sf001(spark, con01, name):
    df = QUERIES[name](spark, SF01)
    assert compare(df, con01, ORACLE[name]) is None


def test_schema_types_match_oracle(spark, con01):
    """Spark and DuckDB agree on column types for a representative set."""
    mapping = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    for name in ("segment_churn", "overall_churn", "column_stats", "rfm_scores", "kpi_text"):
        df = QUERIES[name](spark, SF01)
        desc = {d[0]: str(d[1]) for d in con01.execute(ORACLE[name]).description}
        for col, t in df.dtypes:
            want = mapping.get(t, t.upper())
            assert desc[col].upper() == want, (name, col, t, desc[col])


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["rfm_segment", "total_segment", "total_churned", "churn_rate"]
    assert sum(r["total_segment"] for r in rows) == 132  # cleaned rows at sf0.001
    con = duck(SF001)
    assert compare(df, con, ORACLE["segment_churn_cleaned"]) is None
