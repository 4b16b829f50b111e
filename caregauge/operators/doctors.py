"""Tables per doctor.

The admission fact is aggregated by doctor_id before doctors are joined: a doctor with very many
admissions collapses in the partial aggregate, and the join sees one row per doctor. Ranks go through
rank_over, bounded by the number of doctors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    as_double,
    average_money,
    cents_sum,
    cents_to_double,
    count_true,
    money,
    month_start,
    pct,
    ratio,
    round_half_even,
    round_half_up,
    rounded,
    rows,
)
from ..session import stage
from .fixed import TIER_LABELS, TOP_DOCTORS, TOP_TIER_DOCTORS
from .kpis import recovered
from .ranking import exact_quantiles, fits_window, rank_over

DOCTOR_COLUMNS = ("doctor_id", "doctor_name", "specialization", "experience_years")


def _per_doctor(admissions: DataFrame, *extra) -> DataFrame:
    return admissions.groupBy("doctor_id").agg(
        rows().alias("patients"),
        cents_sum("total_bill").alias("revenue"),
        average_money("total_bill").alias("avg_bill"),
        count_true(recovered()).alias("recoveries"),
        *extra,
    )


def doctor_scorecard(
    doctors: DataFrame, admissions: DataFrame, window_rows: int | None = None
) -> DataFrame:
    """Doctors with at least one admission, ranked within their specialization by revenue and recovery."""
    count = doctors.count()
    # A doctor whose flags are all missing has 0 readmissions here, but none known in api_doctors.
    stats = _per_doctor(
        admissions,
        count_true(F.col("readmitted_30days") == 1).alias("readmissions"),
        F.avg("length_of_stay").alias("avg_los"),
    )
    cards = doctors.join(stats, "doctor_id").select(
        *DOCTOR_COLUMNS[1:],
        F.col("patients").alias("patients_treated"),
        "revenue",
        rounded("avg_bill", 0).alias("avg_bill_per_patient"),
        rounded("avg_los", 1).alias("avg_patient_los"),
        rounded(ratio("recoveries", "patients") * 100, 1).alias("recovery_rate_pct"),
        "readmissions",
    )
    if not fits_window(count, window_rows):
        cards = stage(cards)
    for value, name in (("revenue", "dept_revenue_rank"), ("recovery_rate_pct", "dept_recovery_rank")):
        cards = rank_over(
            cards, value, name, rows=count, groups=["specialization"], window_rows=window_rows
        )
    return (
        cards.withColumn("total_revenue_generated", cents_to_double("revenue"))
        .drop("revenue")
        .orderBy("specialization", "dept_revenue_rank", "doctor_name")
    )


def api_doctors(doctors: DataFrame, admissions: DataFrame, top: int = TOP_DOCTORS) -> DataFrame:
    """Top doctors by revenue. Doctors without admissions stay, with null revenue and 0 recovery."""
    return (
        doctors.join(_per_doctor(admissions, F.sum("readmitted_30days").alias("readmissions")), "doctor_id", "left")
        .select(
            *DOCTOR_COLUMNS,
            F.coalesce("patients", F.lit(0)).alias("patients"),
            rounded(money("revenue"), 0).alias("revenue"),
            rounded("avg_bill", 0).alias("avg_bill"),
            # The unmatched row of a left join still counts as one row.
            rounded(
                pct(F.coalesce("recoveries", F.lit(0)), F.coalesce("patients", F.lit(1))), 1
            ).alias("recovery_rate"),
            "readmissions",
        )
        .orderBy(F.desc_nulls_last("revenue"), "doctor_id")
        .limit(top)
        .drop("doctor_id")
    )


def doctor_monthly_productivity(
    doctors: DataFrame, admissions: DataFrame, window_rows: int | None = None
) -> DataFrame:
    """Average of the monthly revenues (each rounded to whole units first), ranked per specialization."""
    count = doctors.count()
    monthly = admissions.groupBy("doctor_id", month_start("admission_date").alias("month")).agg(
        rows().alias("patients"),
        round_half_up(money(cents_sum("total_bill")), 0).cast("long").alias("revenue"),
    )
    per_doctor = monthly.groupBy("doctor_id").agg(
        F.sum("revenue").alias("revenue"),
        F.count("revenue").alias("revenue_months"),
        F.sum("patients").alias("patients"),
        F.count("month").alias("months"),
    )
    # Doctors of one specialization with equal names are reported together.
    named = (
        per_doctor.join(doctors, "doctor_id")
        .groupBy("doctor_name", "specialization")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("revenue_months").alias("revenue_months"),
            F.sum("patients").alias("total_patients"),
            F.sum("months").alias("active_months"),
        )
        .withColumn("average", ratio("revenue", "revenue_months"))
    )
    if not fits_window(count, window_rows):
        named = stage(named)
    ranked = rank_over(
        named, "average", "rank_in_dept", rows=count, groups=["specialization"], window_rows=window_rows
    )
    return ranked.select(
        "doctor_name",
        "specialization",
        rounded("average", 0).alias("avg_monthly_revenue"),
        as_double("revenue").alias("total_revenue"),
        "total_patients",
        "active_months",
        "rank_in_dept",
    ).orderBy("specialization", "rank_in_dept", "doctor_name")


def report_doctor_tiers(
    doctors: DataFrame,
    admissions: DataFrame,
    top: int = TOP_TIER_DOCTORS,
    window_rows: int | None = None,
) -> DataFrame:
    """Top doctors by revenue with a tier from the exact quartile and median over all doctors."""
    count = doctors.count()
    complete = doctors.dropna(subset=list(DOCTOR_COLUMNS))
    stats = stage(complete.join(_per_doctor(admissions, F.sum("readmitted_30days").alias("readmissions")), "doctor_id"))
    quantiles = exact_quantiles(
        stats, "revenue", [0.75, 0.5], ["upper", "median"], rows=count, window_rows=window_rows
    )
    best, good, average = TIER_LABELS
    limits = quantiles.select(F.struct("upper", "median")).scalar()
    leaders = stats.orderBy(F.desc("revenue"), "doctor_id").limit(top).withColumn("limits", limits)
    return leaders.select(
        *DOCTOR_COLUMNS[1:],
        "patients",
        as_double(F.bround(money("revenue"), 0)).alias("revenue"),
        round_half_even("avg_bill", 0).alias("avg_bill"),
        round_half_even(ratio("recoveries", "patients") * 100, 1).alias("recovery_rate_pct"),
        "readmissions",
        F.when(F.col("revenue") > F.col("limits.upper"), best)
        .when(F.col("revenue") > F.col("limits.median"), good)
        .otherwise(average)
        .alias("performance"),
    )
