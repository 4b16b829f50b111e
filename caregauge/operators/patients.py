"""Tables built from one row per patient. The fact is reduced to patients before any join or ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import (
    as_double,
    average_money,
    cents_sum,
    cents_to_double,
    count_true,
    money,
    pct,
    ratio,
    round_half_up,
    rounded,
    rows,
)
from .fixed import AGE_LABELS, AGE_LIMITS, VISIT_LABELS
from .ranking import ntile_over


def patient_visits(admissions: DataFrame) -> DataFrame:
    """Visits, first and last visit, lifetime value and average spend per patient."""
    return admissions.groupBy("patient_id").agg(
        rows().alias("total_visits"),
        F.min("admission_date").alias("first_visit"),
        F.max("admission_date").alias("last_visit"),
        money(cents_sum("total_bill")).alias("lifetime_value"),
        round_half_up(average_money("total_bill"), 2).alias("avg_spend_per_visit"),
    )


def visit_cohorts(admissions: DataFrame) -> DataFrame:
    """Patients by number of visits; averages are of the per-patient values rounded to cents."""
    one, two, few, many = VISIT_LABELS
    visits = F.col("total_visits")
    segment = F.when(visits == 1, one).when(visits == 2, two).when(visits <= 4, few).otherwise(many)
    return (
        patient_visits(admissions)
        .groupBy(segment.alias("visit_segment"))
        .agg(
            rows().alias("patients_in_segment"),
            rounded(ratio(F.sum("lifetime_value"), F.count("lifetime_value")), 0).alias(
                "avg_lifetime_value"
            ),
            rounded(F.sum("lifetime_value"), 0).alias("segment_total_revenue"),
            rounded(ratio(F.sum("avg_spend_per_visit"), F.count("avg_spend_per_visit")), 0).alias(
                "avg_spend_per_visit"
            ),
        )
        .orderBy(F.desc("avg_lifetime_value"), "visit_segment")
    )


def age_group_profile(
    admissions: DataFrame, patients: DataFrame, critical: str = "Critical"
) -> DataFrame:
    """Admissions by patient age band; a null age falls into the last band.

    The age band depends on the patient alone. So the fact is summed per patient first, and the distinct
    patients of a band are simply its rows.
    """
    per_patient = admissions.groupBy("patient_id").agg(
        rows().alias("admissions"),
        cents_sum("total_bill").alias("revenue"),
        F.count("total_bill").alias("bills"),
        F.sum("length_of_stay").alias("stay"),
        F.count("length_of_stay").alias("stays"),
        F.sum("readmitted_30days").alias("readmissions"),
        count_true(F.col("severity") == critical).alias("critical_cases"),
    )
    band = F.when(F.col("age") < AGE_LIMITS[0], AGE_LABELS[0])
    for limit, label in zip(AGE_LIMITS[1:], AGE_LABELS[1:], strict=False):
        band = band.when(F.col("age") < limit, label)
    return (
        per_patient.join(patients.select("patient_id", "age"), "patient_id")
        .groupBy(band.otherwise(AGE_LABELS[-1]).alias("age_group"))
        .agg(
            F.sum("admissions").alias("admissions"),
            rows().alias("unique_patients"),
            rounded(ratio(cents_to_double(F.sum("revenue")), F.sum("bills")), 0).alias("avg_bill"),
            rounded(money(F.sum("revenue")), 0).alias("total_revenue"),
            rounded(ratio(F.sum("stay"), F.sum("stays")), 1).alias("avg_los"),
            rounded(pct(F.sum("readmissions"), F.sum("admissions")), 1).alias("readmission_rate_pct"),
            F.sum("critical_cases").alias("critical_cases"),
        )
        .orderBy(F.desc("avg_bill"), "age_group")
    )


def spend_deciles(admissions: DataFrame, tiles: int = 10) -> DataFrame:
    """Patients in equal-sized tiles by spend (ties by patient_id), and each tile's share of all bills."""
    spend = admissions.groupBy("patient_id").agg(cents_sum("total_bill").alias("spend"))
    order = [F.desc_nulls_last("spend"), F.asc("patient_id")]
    deciles = (
        ntile_over(spend, order, tiles, "spend_decile")
        .groupBy("spend_decile")
        .agg(rows().alias("patients"), F.sum("spend").alias("revenue"))
    )
    everything = F.sum("revenue").over(W.partitionBy())
    return deciles.select(
        F.col("spend_decile").cast("long").alias("spend_decile"),
        "patients",
        rounded(ratio(cents_to_double("revenue"), "patients"), 0).alias("avg_spend"),
        rounded(money("revenue"), 0).alias("total_revenue"),
        rounded(pct("revenue", everything), 2).alias("pct_of_total_revenue"),
    ).orderBy("spend_decile")


def patient_features(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Spend, visits, average stay and readmissions per patient with age; incomplete patients dropped."""
    stats = (
        admissions.where(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(
            cents_to_double(cents_sum("total_bill")).alias("total_spend"),
            rows().alias("visits"),
            F.avg("length_of_stay").alias("avg_los"),
            F.sum("readmitted_30days").alias("readmissions"),
        )
    )
    return stats.join(patients.select("patient_id", "age"), "patient_id", "left").dropna()


def referred_return_rate(admissions: DataFrame, referred: str = "Referred") -> DataFrame:
    """Share of referred admissions whose patient was admitted again on a later day.

    An admission is followed by another one unless it falls on the patient's last day. So two plain
    aggregates suffice, where a lead() window would sort all rows of a patient in one task.
    """
    days = admissions.groupBy("patient_id", "admission_date").agg(
        count_true(F.col("outcome") == referred).alias("referred")
    )
    per_patient = days.groupBy("patient_id").agg(
        F.sum("referred").alias("referred"),
        F.max_by("referred", "admission_date").alias("referred_on_last_day"),
    )
    # One row without a patient key has no known successor.
    returned = F.when(
        F.col("patient_id").isNotNull(), F.col("referred") - F.col("referred_on_last_day")
    ).otherwise(0)
    return per_patient.agg(
        F.sum("referred").alias("referred_admissions"), F.sum(returned).alias("returned")
    ).select(
        "*", as_double(round_half_up(pct("returned", "referred_admissions"), 2)).alias("return_rate_pct")
    )
