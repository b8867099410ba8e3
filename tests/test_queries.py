"""Every registered query against its SQL counterpart, and the shape of its plan."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

import __spark_entry__ as contract
from taxon.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
# scoring by a model outside the JVM is the one place that needs Python workers
PYTHON_WORKERS = {"udf_batch_score"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 127


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert costly not in plan
    if name not in PYTHON_WORKERS:
        assert "EvalPython" not in plan and "InPandas" not in plan
    result = df.toPandas()
    if name in ORACLES:
        assert differences(result, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(result) > 0
