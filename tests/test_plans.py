"""Plan guards: scale rules checked on the physical plans of registered queries."""
import pytest

from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as E
    return E.queries()


def test_no_registered_query_plans_a_cross_product(spark, registry):
    bad = {}
    for name, fn in registry.items():
        try:
            plan = _plan(fn(spark, SF_SMALL))
        except Exception as e:  # noqa: BLE001 - the others are guarded all the same
            bad[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_page_query_prunes_partitions_and_pushes_filters(spark, registry):
    df = registry["o1_flights_page_filtered"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    explain = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    formatted = df._jdf.queryExecution().explainString(explain)
    assert "TakeOrderedAndProject" in text
    assert "PartitionFilters: [isnotnull(flight_month" in formatted
    assert "EqualTo(operating_airline,BRAND#13)" in formatted


def test_gold_aggregates_partially_and_prunes_columns(spark, registry):
    df = registry["s15_gold_through_sql_views"](spark, SF_SMALL)
    explain = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    formatted = df._jdf.queryExecution().explainString(explain)
    assert "partial_count" in formatted
    assert "PushedFilters: [IsNotNull(origin), EqualTo(origin,NATION_4)]" in formatted
    assert "ReadSchema: struct<operating_airline:string,origin:string,dest:string," in formatted


def test_oversampling_needs_no_global_order(spark, registry):
    # exact class balancing without a global rank: no window, no global sort
    # or top-k, no exchange into one partition
    df = registry["m7_oversampled_class_counts"](spark, SF_SMALL)
    plan = _plan(df)
    for node in ("Window", "SinglePartition", "TakeOrderedAndProject", "GlobalLimit"):
        assert node not in plan, node
    assert "Range" in plan and "Union" in plan
    got = {r.label: r.rows for r in df.collect()}
    assert len(set(got.values())) == 1
