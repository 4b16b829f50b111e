"""Time-bucket tables. A month or day table has few rows, so its ordered windows run in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import (
    as_double,
    average_money,
    cents_sum,
    cents_to_double,
    money,
    month_label,
    month_start,
    pct,
    ratio,
    round_half_even,
    rounded,
    rows,
)
from .fixed import TREND_LABELS

def _by_month() -> WindowSpec:
    return W.orderBy("month")


def _monthly(admissions: DataFrame, *extra) -> DataFrame:
    """Count and exact revenue (cents) per month; grouped on a date, labelled after the aggregation."""
    return admissions.groupBy(month_start("admission_date").alias("month")).agg(
        rows().alias("admissions"), cents_sum("total_bill").alias("revenue"), *extra
    )


def monthly_mom_growth(admissions: DataFrame) -> DataFrame:
    """Month-over-month change. The first month has no predecessor and counts as flat."""
    months = _monthly(admissions).withColumn("previous", F.lag("revenue").over(_by_month()))
    growth, decline, flat = TREND_LABELS
    return months.select(
        month_label("month").alias("year_month"),
        "admissions",
        cents_to_double("revenue").alias("revenue"),
        cents_to_double("previous").alias("prev_month_revenue"),
        rounded(pct(F.col("revenue") - F.col("previous"), "previous"), 2).alias("mom_growth_pct"),
        F.when(F.col("revenue") > F.col("previous"), growth)
        .when(F.col("revenue") < F.col("previous"), decline)
        .otherwise(flat)
        .alias("trend"),
    ).orderBy("year_month")


def rolling_and_cumulative(admissions: DataFrame, months: int = 3) -> DataFrame:
    """Moving average over the last rows (a month without rows is skipped) and the running total."""
    recent = _by_month().rowsBetween(1 - months, W.currentRow)
    average = ratio(cents_to_double(F.sum("revenue").over(recent)), F.count("revenue").over(recent))
    so_far = _by_month().rowsBetween(W.unboundedPreceding, W.currentRow)
    return _monthly(admissions).select(
        month_label("month").alias("ym"),
        "admissions",
        cents_to_double("revenue").alias("revenue"),
        rounded(average, 2).alias(f"rolling_{months}m_avg"),
        cents_to_double(F.sum("revenue").over(so_far)).alias("cumulative_revenue"),
    ).orderBy("ym")


def api_monthly(admissions: DataFrame) -> DataFrame:
    return (
        _monthly(admissions)
        .select(
            month_label("month").alias("ym"), "admissions", rounded(money("revenue"), 0).alias("revenue")
        )
        .orderBy("ym")
    )


def api_yoy(admissions: DataFrame) -> DataFrame:
    return (
        admissions.groupBy(F.year("admission_date").alias("year"))
        .agg(rows().alias("admissions"), rounded(money(cents_sum("total_bill")), 0).alias("revenue"))
        .orderBy("year")
    )


def monthly_trend_line(admissions: DataFrame) -> DataFrame:
    """Monthly revenue, percentage change, and the least-squares line over the month index."""
    months = (
        _monthly(admissions.where(F.col("admission_date").isNotNull()))
        .withColumn("revenue", cents_to_double("revenue"))
        .withColumn("month_index", F.row_number().over(_by_month()) - 1)
    )
    all_months = W.partitionBy()
    change = (ratio("revenue", F.lag("revenue").over(_by_month())) - 1) * 100
    return (
        months.select(
            month_label("month").alias("ym"),
            "month_index",
            "admissions",
            "revenue",
            change.alias("mom_growth"),
            F.regr_slope("revenue", "month_index").over(all_months).alias("slope"),
            F.regr_intercept("revenue", "month_index").over(all_months).alias("intercept"),
        )
        .withColumn("trend_value", F.col("slope") * F.col("month_index") + F.col("intercept"))
        .orderBy("ym")
    )


def monthly_revenue_rollup(admissions: DataFrame) -> DataFrame:
    """The stored rollup table: one row per month, rounded half even."""
    return (
        _monthly(
            admissions.where(F.col("admission_date").isNotNull()),
            F.avg("length_of_stay").alias("los"),
            F.sum("readmitted_30days").alias("readmissions"),
        )
        .select(
            month_label("month").alias("year_month"),
            cents_to_double("revenue").alias("total_revenue"),
            F.col("admissions").alias("total_admissions"),
            round_half_even("los", 2).alias("avg_los"),
            "readmissions",
        )
        .orderBy("year_month")
    )


def report_monthly(admissions: DataFrame) -> DataFrame:
    """Report months: growth as a fraction of the rounded revenue (null for the first) and running total."""
    months = (
        _monthly(
            admissions.where(F.col("admission_date").isNotNull()),
            round_half_even(average_money("total_bill"), 0).alias("avg_bill"),
            F.sum("readmitted_30days").alias("readmissions"),
        )
        .withColumn("revenue", F.bround(money("revenue"), 0))
        .withColumn("previous", F.lag("revenue").over(_by_month()))
    )
    so_far = _by_month().rowsBetween(W.unboundedPreceding, W.currentRow)
    return months.select(
        month_label("month").alias("ym"),
        "admissions",
        as_double("revenue").alias("revenue"),
        "avg_bill",
        "readmissions",
        ratio(F.col("revenue") - F.col("previous"), "previous").alias("mom_growth"),
        as_double(F.sum("revenue").over(so_far)).alias("cumulative_revenue"),
    ).orderBy("ym")


def daily_sales(sales: DataFrame) -> DataFrame:
    """Total per day with change against the previous day that has sales. Columns: sale_date, amount."""
    days = sales.groupBy("sale_date").agg(rows().alias("sales"), cents_sum("amount").alias("total"))
    previous = F.lag("total").over(W.orderBy("sale_date"))
    return days.select(
        "sale_date",
        "sales",
        cents_to_double("total").alias("total_sales"),
        rounded(pct(F.col("total") - previous, previous), 2).alias("growth_pct"),
    ).orderBy("sale_date")


def daily_sales_growth(sales: DataFrame) -> DataFrame:
    """One row: first and last day, peak and dip day (earliest on ties), growth from first to last."""
    days = sales.groupBy("sale_date").agg(cents_sum("amount").alias("total"))
    age = -F.datediff("sale_date", F.lit("1970-01-01").cast("date"))
    return days.agg(
        F.min("sale_date").alias("first_day"),
        F.max("sale_date").alias("last_day"),
        F.max_by("sale_date", F.struct("total", age)).alias("peak_day"),
        cents_to_double(F.max("total")).alias("peak_sales"),
        F.min_by("sale_date", F.struct("total", "sale_date")).alias("dip_day"),
        cents_to_double(F.min("total")).alias("dip_sales"),
        F.min_by("total", "sale_date").alias("opening"),
        F.max_by("total", "sale_date").alias("closing"),
    ).select(
        "first_day",
        "last_day",
        "peak_day",
        "peak_sales",
        "dip_day",
        "dip_sales",
        rounded(pct(F.col("closing") - F.col("opening"), "opening"), 2).alias("growth_pct"),
    )
