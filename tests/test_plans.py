"""Plan properties that matter at scale."""

import pytest

from caregauge.plans.catalog import MODEL_FACTS, RISK_FACTS, all_queries
from caregauge.plans.oracle import all_sql
from caregauge.sources import StarTables

from .conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that write tables first are left out here; they are run in test_catalog.
EAGER = {
    "csv_round_trip",
    "monthly_revenue_table",
    "spend_deciles",
    "report_doctor_tiers",
    "risk_frame",
    "readmission_model_check",
    "feature_importance_check",
    "confusion_matrix_totals",
    "expected_probability_check",
    "segment_patients_check",
    "monthly_rollup_reload",
    "model_auc_check",
    "risk_model_cv_auc_check",
    "risk_model_optimality",
    # A walk over 16 trees is numpy in tasks.
    "forest_scores_of_given",
    "confusion_matrix_of_given_forest",
}
LAZY = [
    name
    for name in sorted(all_sql())
    if name not in EAGER
    and not name.startswith(("attribution", "complexity", "quadrant", "rank_shift", "top_", "experience"))
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(all_queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def scans(df) -> list[str]:
    return [line for line in plan_of(df).splitlines() if "FileScan" in line]


def test_month_queries_read_one_table_and_two_columns(spark):
    lines = scans(all_queries()["monthly_mom_growth"](spark, SF_SMALL))
    assert len(lines) == 1
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in lines[0]


def test_only_needed_dimensions_are_joined(spark):
    lines = scans(all_queries()["dept_revenue_ranking"](spark, SF_SMALL))
    assert sorted(line.split("/")[-1].split(".parquet")[0] for line in lines) == ["lineitem", "nation", "supplier"]


def test_filters_reach_the_scan(spark):
    (line,) = scans(all_queries()["query_read"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in line


def test_left_joins_keep_the_fact_whole(spark):
    star = StarTables(spark, SF_SMALL)
    everything = star.admissions("department_name", "severity", "diagnosis", "insurance_provider", "bed_type")
    assert everything.count() == star.raw("lineitem").count()


def test_joins_to_doctors_come_after_the_aggregate(spark):
    plan = plan_of(all_queries()["api_doctors"](spark, SF_SMALL))
    join = plan.index("Join")
    assert "HashAggregate" in plan[join:], "the fact is aggregated below the join"


@pytest.mark.parametrize("columns", [RISK_FACTS, MODEL_FACTS])
def test_model_rows_read_each_dimension_once(spark, columns):
    found = scans(StarTables(spark, SF_SMALL).admissions(*columns))
    for table in ("customer", "supplier", "orders", "lineitem"):
        assert sum(f"/{table}.parquet" in line for line in found) == 1


def test_executive_kpis_join_no_orders_for_the_departments(spark):
    found = scans(all_queries()["executive_kpis"](spark, SF_SMALL))
    assert sum("/orders.parquet" in line for line in found) == 1
    assert sum("/supplier.parquet" in line for line in found) == 1


def test_attribution_reads_the_fact_twice_and_stages_nothing_of_it(spark):
    found = scans(all_queries()["doctor_case_mix"](spark, SF_SMALL))
    assert sum("/lineitem.parquet" in line for line in found) == 2
    assert not any("staged-" in line for line in found)
