"""Tables per department, diagnosis, payer, procedure and bed type.

Departments, payers and bed types are short vocabularies, so windows over their rows run in one task. Groups by
procedure name or diagnosis, which may be free text, are counted first, and ranked over distributed sorts if
they are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import (
    as_double,
    average_money,
    cents,
    cents_sum,
    cents_to_double,
    count_true,
    money,
    pct,
    ratio,
    round_half_even,
    round_half_up,
    rounded,
    rows,
    share_true,
)
from ..session import stage
from . import fixed
from .kpis import recovered
from .ranking import fits_window, ntile_over, rank_over


def _all_groups() -> WindowSpec:
    return W.partitionBy()


def _rank_desc(column: str) -> Column:
    return F.rank().over(W.orderBy(F.desc(column))).cast("long")


def readmission_pct() -> Column:
    return pct(F.sum("readmitted_30days"), rows())


def dept_revenue_ranking(admissions: DataFrame) -> DataFrame:
    """Revenue, collections and stay per department, with revenue rank and share of the total."""
    departments = admissions.groupBy("department_name").agg(
        rows().alias("total_admissions"),
        cents_sum("total_bill").alias("revenue"),
        average_money("total_bill").alias("avg_bill"),
        cents_sum("insurance_covered").alias("covered"),
        cents_sum("patient_paid").alias("paid"),
        F.avg("length_of_stay").alias("avg_los"),
    )
    return departments.select(
        "department_name",
        "total_admissions",
        cents_to_double("revenue").alias("total_revenue"),
        rounded("avg_bill", 2).alias("avg_bill_per_patient"),
        cents_to_double("covered").alias("insurance_recovered"),
        cents_to_double("paid").alias("patient_collections"),
        rounded("avg_los", 1).alias("avg_length_of_stay"),
        _rank_desc("revenue").alias("revenue_rank"),
        rounded(pct("revenue", F.sum("revenue").over(_all_groups())), 2).alias("revenue_share_pct"),
    ).orderBy("revenue_rank", "department_name")


def api_departments(admissions: DataFrame) -> DataFrame:
    return (
        admissions.groupBy("department_name")
        .agg(
            rows().alias("admissions"),
            rounded(money(cents_sum("total_bill")), 0).alias("revenue"),
            rounded(average_money("total_bill"), 0).alias("avg_bill"),
            rounded(F.avg("length_of_stay"), 1).alias("avg_los"),
            rounded(readmission_pct(), 1).alias("readmission_rate"),
            rounded(share_true(recovered()), 1).alias("recovery_rate"),
        )
        .orderBy(F.desc("revenue"), "department_name")
    )


def department_matrix(
    admissions: DataFrame,
    top: int = fixed.TOP_DEPARTMENTS,
    los_limits: tuple[float, float] = fixed.STAY_LIMITS,
) -> DataFrame:
    """Department metrics with a top-revenue flag, a stay band, and the mean of the department stays."""
    departments = (
        admissions.where(F.col("department_name").isNotNull())
        .groupBy("department_name")
        .agg(
            cents_to_double(cents_sum("total_bill")).alias("revenue"),
            rows().alias("admissions"),
            F.avg("length_of_stay").alias("avg_los"),
            F.avg("readmitted_30days").alias("readmission_rate"),
            average_money("total_bill").alias("avg_bill"),
        )
    )
    by_revenue = W.orderBy(F.desc("revenue"), "department_name")
    long, medium, short = fixed.STAY_BANDS
    return departments.select(
        "*",
        (F.row_number().over(by_revenue) <= top).alias("top_revenue"),
        F.when(F.col("avg_los") > los_limits[0], long)
        .when(F.col("avg_los") > los_limits[1], medium)
        .otherwise(short)
        .alias("los_band"),
        F.avg("avg_los").over(_all_groups()).alias("mean_department_los"),
    ).orderBy("revenue")


def readmission_by_dept_severity(
    admissions: DataFrame,
    min_rows: int = fixed.MIN_SEVERITY_ROWS,
    top: int = fixed.TOP_SEVERITY_CELLS,
) -> DataFrame:
    """(department, severity) cells with enough rows, highest readmission rate first."""
    return (
        admissions.groupBy("department_name", "severity")
        .agg(
            rows().alias("total_admissions"),
            F.sum("readmitted_30days").alias("readmissions"),
            rounded(readmission_pct(), 2).alias("readmission_rate_pct"),
            rounded(F.avg("length_of_stay"), 1).alias("avg_los"),
            rounded(average_money("total_bill"), 0).alias("avg_bill"),
        )
        .where(F.col("total_admissions") >= min_rows)
        .orderBy(F.desc("readmission_rate_pct"), "department_name", "severity")
        .limit(top)
    )


def readmission_heatmap(admissions: DataFrame) -> DataFrame:
    return (
        admissions.groupBy("department_name", "severity")
        .agg(rounded(readmission_pct(), 0).alias("readmission_rate"))
        .orderBy("department_name", "severity")
    )


def readmission_severity_pivot(admissions: DataFrame, severities: Sequence[str]) -> DataFrame:
    """Department rows, one readmission-rate column per severity in the given order, empty cells 0."""
    return (
        admissions.where(F.col("department_name").isNotNull())
        .groupBy("department_name")
        .pivot("severity", list(severities))
        .agg(F.avg("readmitted_30days") * 100)
        .fillna(0.0)
        .orderBy("department_name")
    )


def insurer_leakage(
    admissions: DataFrame, limits: tuple[float, float] = fixed.COVERAGE_LIMITS
) -> DataFrame:
    """Billed, paid and missing amounts per insurer; the class uses the unrounded coverage."""
    billed, covered, paid = (
        cents_sum(c) for c in ("total_bill", "insurance_covered", "patient_paid")
    )
    # The gap is summed row by row, so a row with a missing part counts as missing there too.
    gap = F.sum(cents("total_bill") - cents("insurance_covered") - cents("patient_paid"))
    coverage = pct(covered, billed)
    high, medium, low = fixed.COVERAGE_LABELS
    return (
        admissions.groupBy("insurance_provider")
        .agg(
            rows().alias("total_claims"),
            cents_to_double(billed).alias("total_billed"),
            cents_to_double(covered).alias("total_insurer_paid"),
            cents_to_double(paid).alias("total_patient_paid"),
            cents_to_double(gap).alias("revenue_gap"),
            rounded(coverage, 1).alias("insurer_coverage_pct"),
            rounded(average_money("total_bill"), 0).alias("avg_claim_value"),
            F.when(coverage >= limits[0], high)
            .when(coverage >= limits[1], medium)
            .otherwise(low)
            .alias("coverage_category"),
        )
        .orderBy(F.desc("total_billed"), "insurance_provider")
    )


def api_insurance(admissions: DataFrame, top: int = fixed.TOP_INSURERS) -> DataFrame:
    return (
        admissions.groupBy("insurance_provider")
        .agg(
            rows().alias("claims"),
            rounded(money(cents_sum("total_bill")), 0).alias("billed"),
            rounded(money(cents_sum("insurance_covered")), 0).alias("covered"),
            rounded(money(cents_sum("patient_paid")), 0).alias("patient_paid"),
        )
        .orderBy(F.desc("billed"), "insurance_provider")
        .limit(top)
    )


def insurance_breakdown(
    admissions: DataFrame, limits: tuple[float, float] = fixed.COVERAGE_BAND_LIMITS
) -> DataFrame:
    """Unrounded insurer totals, the gap clipped at zero, and the chart's coverage band."""
    insurers = (
        admissions.where(F.col("insurance_provider").isNotNull())
        .groupBy("insurance_provider")
        .agg(
            rows().alias("claims"),
            cents_sum("total_bill").alias("billed"),
            cents_sum("insurance_covered").alias("covered"),
            cents_sum("patient_paid").alias("collected"),
        )
    )
    gap = F.col("billed") - F.col("covered") - F.col("collected")
    coverage = ratio(cents_to_double("covered"), cents_to_double("billed")) * 100
    good, moderate, low = fixed.COVERAGE_BANDS
    return insurers.select(
        "insurance_provider",
        "claims",
        *(cents_to_double(c).alias(c) for c in ("billed", "covered", "collected")),
        cents_to_double(gap).alias("gap"),
        cents_to_double(F.greatest(gap, F.lit(0))).alias("gap_clipped"),
        coverage.alias("coverage_pct"),
        F.when(coverage >= limits[0], good)
        .when(coverage >= limits[1], moderate)
        .otherwise(low)
        .alias("coverage_band"),
    ).orderBy(F.desc("billed"), "insurance_provider")


def top_procedures(
    procedures: DataFrame,
    admissions: DataFrame,
    top: int = fixed.TOP_PROCEDURES,
    window_rows: int | None = None,
) -> DataFrame:
    """Procedures by (name, admitting department); the quartile is taken over all groups, before the limit."""
    parents = admissions.select("admission_id", "department_name")
    groups = (
        procedures.select("admission_id", "procedure_name", "cost")
        .join(parents, "admission_id")
        .groupBy("procedure_name", "department_name")
        .agg(
            rows().alias("times_performed"),
            cents_sum("cost").alias("revenue"),
            rounded(average_money("cost"), 0).alias("avg_cost"),
            rounded(F.min("cost"), 0).alias("min_cost"),
            rounded(F.max("cost"), 0).alias("max_cost"),
        )
    )
    by_revenue = [F.desc("revenue"), F.asc("procedure_name"), F.asc("department_name")]
    # Names may be many; past window_rows groups the quartile is taken over a distributed sort.
    groups = stage(groups)
    if fits_window(groups.count(), window_rows):
        tiled = groups.withColumn("revenue_quartile", F.ntile(4).over(W.orderBy(*by_revenue)))
    else:
        tiled = ntile_over(groups, by_revenue, 4, "revenue_quartile")
    return (
        tiled
        .withColumn("total_revenue", cents_to_double("revenue"))
        .orderBy(*by_revenue)
        .limit(top)
        .drop("revenue")
    )


def bed_utilisation(admissions: DataFrame) -> DataFrame:
    bill, stay = average_money("total_bill"), F.avg("length_of_stay")
    return (
        admissions.groupBy("bed_type", "admission_type")
        .agg(
            rows().alias("admissions"),
            rounded(stay, 1).alias("avg_los_days"),
            rounded(bill, 0).alias("avg_bill"),
            rounded(money(cents_sum("total_bill")), 0).alias("total_revenue"),
            rounded(ratio(bill, stay), 0).alias("revenue_per_day"),
            rounded(readmission_pct(), 1).alias("readmission_rate_pct"),
        )
        .orderBy(F.desc("avg_bill"), "bed_type", "admission_type")
    )


def yoy_pivot(admissions: DataFrame, years: Sequence[int]) -> DataFrame:
    """Department revenue per year (rounded to whole units first) and growth from first to last year."""
    yearly = (
        admissions.groupBy("department_name", F.year("admission_date").alias("yr"))
        .agg(round_half_up(money(cents_sum("total_bill")), 0).cast("decimal(20,0)").alias("revenue"))
    )
    by_year = {y: f"rev_{y}" for y in years}
    wide = yearly.groupBy("department_name").agg(
        *(
            F.sum(F.when(F.col("yr") == y, F.col("revenue")).otherwise(F.lit(0))).alias(name)
            for y, name in by_year.items()
        )
    )
    first, last = by_year[years[0]], by_year[years[-1]]
    growth = f"growth_{years[0]}_to_{years[-1]}_pct"
    return wide.select(
        "department_name",
        *(as_double(name).alias(name) for name in by_year.values()),
        rounded(pct(F.col(last) - F.col(first), first), 1).alias(growth),
    ).orderBy(F.desc(growth), "department_name")


def diagnosis_rank(
    admissions: DataFrame,
    min_cases: int = fixed.MIN_DIAGNOSIS_CASES,
    top: int = fixed.TOP_DIAGNOSES,
    window_rows: int | None = None,
) -> DataFrame:
    """(diagnosis, department) groups with enough cases; dense ranks before the limit."""
    groups = stage(
        admissions.groupBy("diagnosis", "department_name")
        .agg(
            rows().alias("cases"),
            average_money("total_bill").alias("avg_bill"),
            rounded(money(cents_sum("total_bill")), 0).alias("total_revenue"),
            rounded(F.avg("length_of_stay"), 1).alias("avg_los"),
            rounded(readmission_pct(), 1).alias("readmission_rate_pct"),
        )
        .where(F.col("cases") >= min_cases)
    )
    # Diagnoses may be free text; past window_rows groups the ranks are taken over distributed sorts.
    count = groups.count()
    for value, name in (("cases", "frequency_rank"), ("avg_bill", "cost_rank")):
        groups = rank_over(groups, value, name, rows=count, method="dense", window_rows=window_rows)
    return (
        groups.select(
            "diagnosis",
            "department_name",
            "cases",
            rounded("avg_bill", 0).alias("avg_treatment_cost"),
            "total_revenue",
            "avg_los",
            "readmission_rate_pct",
            "frequency_rank",
            "cost_rank",
        )
        .orderBy(F.desc("cases"), "diagnosis", "department_name")
        .limit(top)
    )


def report_dept_summary(admissions: DataFrame) -> DataFrame:
    """Report table per department, values rounded half even; the share is a fraction of the rounded sum."""
    departments = (
        admissions.where(F.col("department_name").isNotNull())
        .groupBy("department_name")
        .agg(
            rows().alias("admissions"),
            cents_sum("total_bill").alias("exact_revenue"),
            round_half_even(average_money("total_bill"), 0).alias("avg_bill"),
            round_half_even(F.avg("length_of_stay"), 1).alias("avg_los"),
            round_half_even(F.avg("readmitted_30days") * 100, 1).alias("readmission_pct"),
        )
        .withColumn("revenue", F.bround(money("exact_revenue"), 0))
    )
    return departments.orderBy(F.desc("exact_revenue"), "department_name").select(
        "department_name",
        "admissions",
        as_double("revenue").alias("revenue"),
        "avg_bill",
        "avg_los",
        "readmission_pct",
        ratio("revenue", F.sum("revenue").over(_all_groups())).alias("revenue_share"),
    )


def report_dept_total_row(summary: DataFrame) -> DataFrame:
    """The summary plus a TOTAL row: sums, and unweighted means of the department averages."""
    total = summary.agg(
        F.lit("TOTAL").alias("department_name"),
        F.sum("admissions").alias("admissions"),
        F.sum("revenue").alias("revenue"),
        F.avg("avg_bill").alias("avg_bill"),
        F.avg("avg_los").alias("avg_los"),
        F.lit(None).cast("double").alias("readmission_pct"),
        F.lit(None).cast("double").alias("revenue_share"),
    )
    return summary.unionByName(total)


def report_diagnosis_top(
    admissions: DataFrame, top: int = fixed.TOP_DIAGNOSES, risk: float = fixed.READMISSION_RISK
) -> DataFrame:
    """Most frequent (diagnosis, department) groups, flagged when the readmission rate is above risk."""
    groups = (
        admissions.where(F.col("diagnosis").isNotNull() & F.col("department_name").isNotNull())
        .groupBy("diagnosis", "department_name")
        .agg(
            rows().alias("cases"),
            round_half_even(average_money("total_bill"), 0).alias("avg_cost"),
            as_double(F.bround(money(cents_sum("total_bill")), 0)).alias("total_revenue"),
            round_half_even(F.avg("length_of_stay"), 1).alias("avg_los"),
            F.avg("readmitted_30days").alias("rate"),
        )
    )
    return (
        groups.orderBy(F.desc("cases"), "diagnosis", "department_name")
        .limit(top)
        .select(
            "diagnosis",
            "department_name",
            "cases",
            "avg_cost",
            "total_revenue",
            "avg_los",
            round_half_even(F.col("rate") * 100, 1).alias("readmission_rate_pct"),
            (F.col("rate") > risk).alias("high_readmission"),
        )
    )


def success_rate_vs_benchmark(
    admissions: DataFrame, benchmark: float = fixed.SUCCESS_BENCHMARK
) -> DataFrame:
    """Percentage of recovered or improved outcomes per department, against a target."""
    return (
        admissions.groupBy("department_name")
        .agg(
            rows().alias("admissions"),
            count_true(F.col("outcome").isin("Recovered", "Improved")).alias("successes"),
        )
        .select(
            "*",
            rounded(pct("successes", "admissions"), 2).alias("success_rate_pct"),
            (pct("successes", "admissions") < benchmark).alias("below_benchmark"),
        )
        .orderBy("success_rate_pct", "department_name")
    )
