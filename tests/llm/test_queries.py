"""The registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from conftest import SF_DIR
from tenantlens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    state, rows, _, note = compare(spark, con, SF_DIR, key, QUERIES[key], ORACLES.get(key))
    assert state == ("ok" if key in ORACLES else "rows-only") and rows > 0, note


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_native_queries_run_no_python(spark):
    for key in ("op2_line_frequency", "op10_prefix_decontamination"):
        plan = QUERIES[key](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), key
