"""Every registered query of the engine against its SQL."""

import pytest

from cloakfield import queries as Q
from tests.compare import connect, same


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, data, duck, name):
    assert same(Q.queries()[name](spark, data), duck, Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_has_rows(spark, data, name):
    assert Q.queries()[name](spark, data).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    from cloakfield.operators.filters import clause

    df = events.where(clause(events, {"range": {"ts": {"gte": "2024-01-05"}}})).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
