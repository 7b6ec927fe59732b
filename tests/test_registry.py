"""Every registered query against its SQL, at the smallest scale."""

import re

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from conftest import SF_DIR

OWN = {k: f for k, f in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}  # the rest has tests of its own
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(OWN))
def test_query_matches_sql(spark, con, key):
    state, _, _, note = compare(spark, con, SF_DIR, key, OWN[key], ORACLES.get(key))
    assert state in ("ok", "rows-only"), note


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_only_the_fitted_model_lacks_sql():
    assert set(OWN) - set(ORACLES) == {"m1_churn_model"}


def test_no_cross_join_in_plans(spark):
    for key in ("e9_executive_kpis", "d10_single_row_aggregates", "m16_vector_search", "g6_visible_rows", "e50_demand_forecast"):
        plan = entry.queries()[key](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, key


TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("key", ["b1_stg_customers", "e1_subscription_metrics", "e4_customer_360_weighted", "e47_oee", "q13_action_queue", "a2_land_api_usage"])
def test_column_types_agree(spark, con, key):
    duck_types = {r[0]: TYPES.get(r[1], r[1]) for r in con.execute("DESCRIBE " + ORACLES[key]).fetchall()}
    assert dict(entry.queries()[key](spark, SF_DIR).dtypes) == duck_types
