"""One-row KPI summaries and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    average_money,
    cents_sum,
    cents_to_double,
    count_true,
    pct,
    ratio,
    rounded,
    rows,
)
from .fixed import CRORE

def recovered() -> Column:
    return F.col("outcome") == "Recovered"


def _kpi_columns() -> dict[str, Column]:
    return {
        "unique_patients": F.count_distinct("patient_id"),
        "total_admissions": rows(),
        "total_revenue": cents_to_double(cents_sum("total_bill")),
        "avg_bill": average_money("total_bill"),
        "avg_los": F.avg("length_of_stay"),
        "readmission_rate": F.avg("readmitted_30days") * 100,
        "insurance_pct": ratio(
            cents_to_double(cents_sum("insurance_covered")), cents_to_double(cents_sum("total_bill"))
        )
        * 100,
        "recovery_rate": ratio(count_true(recovered()), rows()) * 100,
    }


def _sql_kpi_columns() -> dict[str, Column]:
    """As above, but rows without a readmission flag count in the rate's denominator."""
    return {**_kpi_columns(), "readmission_rate": pct(F.sum("readmitted_30days"), rows())}


def kpi_overview(admissions: DataFrame) -> DataFrame:
    """The eight headline KPIs, unrounded."""
    return admissions.agg(*(column.alias(name) for name, column in _kpi_columns().items()))


def api_kpis(admissions: DataFrame) -> DataFrame:
    """The eight KPIs rounded for display, revenue in crore."""
    summary = admissions.agg(*(column.alias(name) for name, column in _sql_kpi_columns().items()))
    return summary.select(
        rounded(ratio("total_revenue", F.lit(CRORE)), 2).alias("total_revenue_crore"),
        "total_admissions",
        "unique_patients",
        rounded("avg_bill", 0).alias("avg_bill"),
        rounded("avg_los", 1).alias("avg_los"),
        rounded("readmission_rate", 1).alias("readmission_rate"),
        rounded("insurance_pct", 1).alias("insurance_pct"),
        rounded("recovery_rate", 1).alias("recovery_rate"),
    )


def executive_kpis(admissions: DataFrame, bills: DataFrame | None = None) -> DataFrame:
    """One row of KPIs with the department of highest revenue.

    Distinct patients and the top department need different groupings, so the fact is read twice. bills:
    the same admissions with department_name and total_bill only, if they can be had with fewer joins.
    """
    bills = admissions if bills is None else bills
    departments = bills.groupBy("department_name").agg(cents_sum("total_bill").alias("revenue"))
    # Equal revenue: the alphabetically first name.
    top_department = (
        departments.orderBy(F.desc("revenue"), F.asc("department_name")).limit(1).select("department_name")
    )
    columns = _sql_kpi_columns()
    columns["recoveries"] = F.count_if(recovered())
    summary = admissions.agg(*(column.alias(name) for name, column in columns.items()))
    return summary.select(
        F.col("unique_patients").alias("total_unique_patients"),
        "total_admissions",
        rounded(ratio("total_revenue", F.lit(CRORE)), 2).alias("total_revenue_crore"),
        rounded("avg_bill", 0).alias("avg_bill_per_admission"),
        rounded("avg_los", 1).alias("avg_length_of_stay"),
        rounded("readmission_rate", 2).alias("overall_readmission_rate_pct"),
        rounded("insurance_pct", 1).alias("insurance_coverage_pct"),
        top_department.scalar().alias("top_revenue_dept"),
        F.col("recoveries").alias("total_recoveries"),
        rounded("recovery_rate", 1).alias("recovery_rate_pct"),
    )


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(rows().alias("total")).orderBy(F.desc("total"), column)
