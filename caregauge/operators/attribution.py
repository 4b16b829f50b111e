"""Risk-adjusted attribution: a doctor's readmissions against those expected from the case mix.

Input to doctor_case_mix is one row per admission with an expected probability; everything after works
on one row per doctor, staged once. Medians and ranks are exact at any number of doctors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    as_double,
    cents_sum,
    cents_to_double,
    count_true,
    ratio,
    round_half_even,
    rows,
)
from ..session import stage
from .fixed import CORRELATION_LIMIT, HIDDEN_STAR, OVERLOADED, QUALITY_GAP, SCORE_COLUMNS, SOLID
from .kpis import recovered
from .ranking import exact_quantiles, rank_over

def doctor_case_mix(scored: DataFrame, doctors: DataFrame) -> DataFrame:
    """Counts and rates per doctor. Admissions are summed by doctor_id before doctors are joined.

    scored: doctor_id, readmitted_30days, expected_prob, severity_code, age, total_bill, outcome.
    Admissions without a complete doctor are left out. n_patients counts admissions.
    """
    stats = scored.groupBy("doctor_id").agg(
        rows().alias("n_patients"),
        F.avg("readmitted_30days").alias("actual_readmit_rate"),
        ratio(F.sum("expected_prob"), F.count("expected_prob")).alias("expected_readmit_rate"),
        F.avg("severity_code").alias("avg_severity"),
        F.avg("age").alias("avg_patient_age"),
        cents_to_double(cents_sum("total_bill")).alias("revenue_generated"),
        ratio(count_true(recovered()), rows()).alias("recovery_rate"),
    )
    return (
        doctors.select("doctor_id", "doctor_name", "specialization", "experience_years")
        .dropna()
        .join(stats, "doctor_id")
        # The panel's mean risk is both the expected rate and the complexity.
        .withColumn("avg_complexity", F.col("expected_readmit_rate"))
    )


def attribution_score(case_mix: DataFrame) -> DataFrame:
    """Add actual - expected, and the same scaled so that the largest deviation is 100."""
    scored = case_mix.withColumn(
        "attribution_score", F.col("actual_readmit_rate") - F.col("expected_readmit_rate")
    )
    largest = scored.agg(F.max(F.abs("attribution_score"))).scalar()
    return scored.withColumn(
        "attribution_score_norm", round_half_even(ratio("attribution_score", largest) * 100, 1)
    )


def complexity_score(case_mix: DataFrame) -> DataFrame:
    """Add the min-max scaled complexity, 0 to 100; null when all doctors are equal."""
    bounds = case_mix.agg(
        F.struct(F.min("avg_complexity").alias("low"), F.max("avg_complexity").alias("high"))
    ).scalar()
    low, high = bounds["low"], bounds["high"]
    share = ratio(F.col("avg_complexity") - low, high - low)
    return case_mix.withColumn("complexity_score", round_half_even(share * 100, 1))


def quadrant(scores: DataFrame, rows_bound: int, window_rows: int | None = None) -> DataFrame:
    """Split at the median complexity score and the median actual rate; a value at the median is high."""

    def median(column: str):
        return exact_quantiles(
            scores, column, [0.5], ["median"], rows=rows_bound, window_rows=window_rows
        ).scalar()

    # A missing score compares as not high.
    complex_panel = F.coalesce(F.col("complexity_score") >= median("complexity_score"), F.lit(False))
    readmits = F.coalesce(F.col("actual_readmit_rate") >= median("actual_readmit_rate"), F.lit(False))
    return scores.withColumn(
        "quadrant",
        F.when(complex_panel & ~readmits, HIDDEN_STAR)
        .when(complex_panel, OVERLOADED)
        .when(~readmits, SOLID)
        .otherwise(QUALITY_GAP),
    )


def rank_shift(scores: DataFrame, rows_bound: int, window_rows: int | None = None) -> DataFrame:
    """Add raw rank, adjusted rank (ties share their mean rank) and their difference, rounded half even."""
    for value, name in (("actual_readmit_rate", "raw_rank"), ("attribution_score_norm", "adj_rank")):
        scores = rank_over(
            scores,
            value,
            name,
            rows=rows_bound,
            descending=False,
            method="average",
            window_rows=window_rows,
        )
    return scores.withColumn("rank_shift", F.rint(F.col("raw_rank") - F.col("adj_rank")))


def score_doctors(case_mix: DataFrame, window_rows: int | None = None) -> DataFrame:
    """All scores per doctor, unrounded rates included. Staged, since many small reports read it."""
    mix = stage(case_mix)
    count = mix.count()
    scores = stage(complexity_score(attribution_score(mix)))
    return stage(rank_shift(quadrant(scores, count, window_rows), count, window_rows))


def attribution_scores(scores: DataFrame) -> DataFrame:
    """The published score table: rounded and sorted, best performers first."""
    rates = ("actual_readmit_rate", "expected_readmit_rate", "recovery_rate")
    return (
        scores.orderBy("attribution_score_norm", "doctor_id")
        .withColumns({rate: round_half_even(rate, 3) for rate in rates})
        .withColumn("revenue_generated", round_half_even("revenue_generated", 0))
        .select(*SCORE_COLUMNS)
    )


def top_hidden_stars(scores: DataFrame, top: int = 3) -> DataFrame:
    return (
        scores.where(F.col("quadrant") == HIDDEN_STAR)
        .orderBy(F.desc("complexity_score"), "doctor_id")
        .limit(top)
    )


def top_quality_gaps(scores: DataFrame, top: int = 3) -> DataFrame:
    return (
        scores.where(F.col("quadrant") == QUALITY_GAP)
        .orderBy(F.desc("attribution_score_norm"), "doctor_id")
        .limit(top)
    )


def top_rank_shift(scores: DataFrame, top: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("rank_shift"), "doctor_id").limit(top)


def rank_shift_extremes(scores: DataFrame, each: int = 10) -> DataFrame:
    """The largest and smallest shifts; a doctor in both lists appears once."""
    low = scores.orderBy(F.asc("rank_shift"), "doctor_id").limit(each)
    both = top_rank_shift(scores, each).unionByName(low)
    return both.dropDuplicates(["doctor_id"]).orderBy("rank_shift", "doctor_id")


def dept_actual_vs_expected(scores: DataFrame) -> DataFrame:
    """Unweighted means of the doctors' rates per specialization."""
    return (
        scores.groupBy("specialization")
        .agg(
            F.avg("actual_readmit_rate").alias("actual"),
            F.avg("expected_readmit_rate").alias("expected"),
            F.sum("n_patients").alias("n"),
        )
        .orderBy("actual", "specialization")
    )


def experience_effect(scores: DataFrame) -> DataFrame:
    """Linear fit and correlation of experience against the score, with a verdict."""
    y, x = "attribution_score_norm", "experience_years"
    fit = scores.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(as_double(x), y).alias("pearson_r"),
    )
    return fit.withColumn(
        "verdict",
        F.when(F.col("pearson_r") < -CORRELATION_LIMIT, "experienced doctors perform better")
        .when(F.col("pearson_r") > CORRELATION_LIMIT, "experience does not predict quality")
        .otherwise("no strong relationship"),
    )


def quadrant_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("quadrant").agg(rows().alias("doctors")).orderBy("quadrant")


def complexity_extremes(scores: DataFrame) -> DataFrame:
    """The doctors with the most and the least complex panels; ties go to the lower doctor_id."""
    columns = ["doctor_id", "doctor_name", "specialization", "complexity_score", "actual_readmit_rate"]
    known = scores.where(F.col("complexity_score").isNotNull()).select(*columns)
    most = known.orderBy(F.desc("complexity_score"), "doctor_id").limit(1)
    least = known.orderBy(F.asc("complexity_score"), "doctor_id").limit(1)
    return most.withColumn("panel", F.lit("most complex")).unionByName(
        least.withColumn("panel", F.lit("least complex"))
    )
