"""Every query by name, over the star-schema tables of one folder.

Thresholds and sizes are parameters of the operators. The values here differ from the defaults only where
the defaults would select all or none of these tables' groups. Models are fitted in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pct, round_half_up
from ..operators import attribution as att
from ..operators import departments as dep
from ..operators import doctors as doc
from ..operators import kpis
from ..operators import operations as ops
from ..operators import patients as pat
from ..operators import readmission_model as forest
from ..operators import risk_model as risk
from ..operators import segmentation as seg
from ..operators import trends
from ..operators.learning import auc_table, dictionary, stratified_folds
from ..session import scratch_folder, stage
from ..sources import (
    StarTables,
    json_records,
    read_query,
    read_table,
    row_counts,
    with_date_parts,
    write_csv,
    write_parts,
    write_table,
)
from .given import forest_rows

Query = Callable[[SparkSession, str], DataFrame]

SEVERITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CRITICAL = SEVERITIES[0]
YEARS = (1996, 1997, 1998, 1999, 2000)
COVERAGE = (5.01, 4.99)  # discounts average 5 percent
MIN_CELL = 470
MIN_CASES = 100
LOS = (25.5, 25.0)
BENCHMARK = 50.0
RISK = 0.33
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

BILLS = ("total_bill", "insurance_covered", "patient_paid")
KPI_COLUMNS = ("patient_id", *BILLS[:2], "length_of_stay", "readmitted_30days", "outcome")
DOCTOR_FACTS = ("doctor_id", "total_bill", "outcome", "readmitted_30days")

_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(StarTables(spark, folder))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _round_columns(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round results of floating-point fits, whose last bits depend on the order of summation."""
    return df.withColumns({c: round_half_up(c, digits).cast("double") for c in columns})


# --- sources and sinks ---------------------------------------------------------------------------


@_query
def table_read(t):
    return read_table(t.spark, "parquet", f"{t.folder}/customer.parquet")


@_query
def query_read(t):
    sql = """
        SELECT o_orderpriority AS severity, count(*) AS total
        FROM {orders} WHERE o_totalprice >= 1000 GROUP BY o_orderpriority
    """
    return read_query(t.spark, sql, orders=t.raw("orders"))


@_query
def csv_round_trip(t):
    table = trends.api_yoy(t.admissions("admission_date", "total_bill"))
    path = f"{scratch_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    write_csv(table, path)
    return read_table(t.spark, "csv", path, schema=table.schema)


@_query
def monthly_revenue_table(t):
    """The rollup stored as a table, replacing the one that is there."""
    columns = ("admission_date", "total_bill", "length_of_stay", "readmitted_30days")
    rollup = trends.monthly_revenue_rollup(t.admissions(*columns))
    path = f"{scratch_folder(t.spark)}/monthly-revenue-{uuid.uuid4().hex}"
    write_table(t.spark.range(1).select(F.lit("old").alias("year_month")), path)
    write_table(rollup, path)
    return read_table(t.spark, "parquet", path)


RELOADED = ("1997-03", "1998-11")
LEAST_BILL = 1000


@_query
def monthly_rollup_reload(t):
    """The stored rollup after a second load, of two months, in which bills below a limit are gone."""
    facts = t.admissions("admission_date", "total_bill", "length_of_stay", "readmitted_30days")
    path = f"{scratch_folder(t.spark)}/monthly-rollup-{uuid.uuid4().hex}"
    whole = trends.monthly_revenue_rollup(facts)
    write_parts(whole, path, ["year_month"])
    again = facts.where(F.date_format("admission_date", "yyyy-MM").isin(*RELOADED) & (F.col("total_bill") >= LEAST_BILL))
    write_parts(trends.monthly_revenue_rollup(again), path, ["year_month"])
    return read_table(t.spark, "parquet", path, schema=whole.schema)


@_query
def table_row_counts(t):
    return row_counts({name: t.raw(name) for name in TABLES})


@_query
def json_output(t):
    return json_records(kpis.frequency_table(t.admissions("severity"), "severity"))


@_query
def date_columns(t):
    orders = t.raw("orders").select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("order_date")
    )
    return with_date_parts(orders, "order_date")


# --- departments, diagnoses, payers, procedures ----------------------------------------------------


@_query
def dept_revenue_ranking(t):
    return dep.dept_revenue_ranking(t.admissions("department_name", *BILLS, "length_of_stay"))


@_query
def readmission_by_dept_severity(t):
    columns = ("department_name", "severity", "readmitted_30days", "length_of_stay", "total_bill")
    return dep.readmission_by_dept_severity(t.admissions(*columns), min_rows=MIN_CELL)


@_query
def insurer_leakage(t):
    return dep.insurer_leakage(t.admissions("insurance_provider", *BILLS), COVERAGE)


@_query
def top_procedures(t):
    procedures = t.procedures("admission_id", "procedure_name", "cost")
    return dep.top_procedures(procedures, t.order_admissions())


@_query
def bed_utilisation(t):
    columns = ("bed_type", "admission_type", "length_of_stay", "total_bill", "readmitted_30days")
    return dep.bed_utilisation(t.admissions(*columns))


@_query
def yoy_pivot(t):
    return dep.yoy_pivot(t.admissions("department_name", "admission_date", "total_bill"), YEARS)


@_query
def diagnosis_rank(t):
    columns = ("diagnosis", "department_name", "total_bill", "length_of_stay", "readmitted_30days")
    return dep.diagnosis_rank(t.admissions(*columns), min_cases=MIN_CASES)


@_query
def api_departments(t):
    columns = ("department_name", "total_bill", "length_of_stay", "readmitted_30days", "outcome")
    return dep.api_departments(t.admissions(*columns))


@_query
def api_insurance(t):
    return dep.api_insurance(t.admissions("insurance_provider", *BILLS), top=4)


@_query
def api_readmission_heatmap(t):
    return dep.readmission_heatmap(t.admissions("department_name", "severity", "readmitted_30days"))


@_query
def department_matrix(t):
    columns = ("department_name", "total_bill", "length_of_stay", "readmitted_30days")
    matrix = dep.department_matrix(t.admissions(*columns), los_limits=LOS)
    return _round_columns(matrix, 6, "mean_department_los")


@_query
def readmission_severity_pivot(t):
    columns = ("department_name", "severity", "readmitted_30days")
    return dep.readmission_severity_pivot(t.admissions(*columns), SEVERITIES)


@_query
def insurance_breakdown(t):
    return dep.insurance_breakdown(t.admissions("insurance_provider", *BILLS), COVERAGE)


@_query
def report_dept_summary(t):
    columns = ("department_name", "total_bill", "length_of_stay", "readmitted_30days")
    return dep.report_dept_summary(t.admissions(*columns))


@_query
def report_dept_total_row(t):
    columns = ("department_name", "total_bill", "length_of_stay", "readmitted_30days")
    with_total = dep.report_dept_total_row(dep.report_dept_summary(t.admissions(*columns)))
    return _round_columns(with_total, 6, "avg_bill", "avg_los")


@_query
def report_diagnosis_top(t):
    columns = ("diagnosis", "department_name", "total_bill", "length_of_stay", "readmitted_30days")
    return dep.report_diagnosis_top(t.admissions(*columns), risk=RISK)


@_query
def success_rate_vs_benchmark(t):
    return dep.success_rate_vs_benchmark(t.admissions("department_name", "outcome"), BENCHMARK)


# --- time ------------------------------------------------------------------------------------------


@_query
def monthly_mom_growth(t):
    return trends.monthly_mom_growth(t.admissions("admission_date", "total_bill"))


@_query
def rolling_and_cumulative(t):
    return trends.rolling_and_cumulative(t.admissions("admission_date", "total_bill"))


@_query
def api_monthly(t):
    return trends.api_monthly(t.admissions("admission_date", "total_bill"))


@_query
def api_yoy(t):
    return trends.api_yoy(t.admissions("admission_date", "total_bill"))


@_query
def monthly_trend_line(t):
    line = trends.monthly_trend_line(t.admissions("admission_date", "total_bill"))
    return _round_columns(line, 2, "slope", "intercept", "trend_value")


@_query
def monthly_revenue_rollup(t):
    columns = ("admission_date", "total_bill", "length_of_stay", "readmitted_30days")
    return trends.monthly_revenue_rollup(t.admissions(*columns))


@_query
def report_monthly(t):
    return trends.report_monthly(t.admissions("admission_date", "total_bill", "readmitted_30days"))


@_query
def daily_sales(t):
    return trends.daily_sales(t.sales("sale_date", "amount"))


@_query
def daily_sales_growth(t):
    return trends.daily_sales_growth(t.sales("sale_date", "amount"))


# --- KPIs and frequencies --------------------------------------------------------------------------


@_query
def executive_kpis(t):
    bills = t.admissions("department_name", "total_bill")
    return kpis.executive_kpis(t.admissions(*KPI_COLUMNS), bills)


@_query
def api_kpis(t):
    return kpis.api_kpis(t.admissions(*KPI_COLUMNS))


@_query
def kpi_overview(t):
    return kpis.kpi_overview(t.admissions(*KPI_COLUMNS))


@_query
def api_severity(t):
    return kpis.frequency_table(t.admissions("severity"), "severity")


@_query
def api_outcomes(t):
    return kpis.frequency_table(t.admissions("outcome"), "outcome")


@_query
def api_bed_types(t):
    return kpis.frequency_table(t.admissions("bed_type"), "bed_type")


# --- doctors ---------------------------------------------------------------------------------------


@_query
def doctor_scorecard(t):
    return doc.doctor_scorecard(t.doctors(), t.admissions(*DOCTOR_FACTS, "length_of_stay"))


@_query
def api_doctors(t):
    return doc.api_doctors(t.doctors(), t.admissions(*DOCTOR_FACTS))


@_query
def doctor_monthly_productivity(t):
    facts = t.admissions("doctor_id", "admission_date", "total_bill")
    return doc.doctor_monthly_productivity(t.doctors(), facts)


@_query
def report_doctor_tiers(t):
    return doc.report_doctor_tiers(t.doctors(), t.admissions(*DOCTOR_FACTS))


# --- patients --------------------------------------------------------------------------------------

PATIENT_FACTS = ("patient_id", "total_bill", "length_of_stay", "readmitted_30days")


@_query
def visit_cohorts(t):
    return pat.visit_cohorts(t.admissions("patient_id", "admission_date", "total_bill"))


@_query
def patient_visits(t):
    visits = pat.patient_visits(t.admissions("patient_id", "admission_date", "total_bill"))
    money = ("lifetime_value", "avg_spend_per_visit")
    return visits.withColumns({c: F.col(c).cast("double") for c in money})


@_query
def age_group_profile(t):
    return pat.age_group_profile(t.admissions(*PATIENT_FACTS, "severity"), t.patients(), CRITICAL)


@_query
def spend_deciles(t):
    return pat.spend_deciles(t.admissions("patient_id", "total_bill"))


@_query
def patient_features(t):
    return pat.patient_features(t.admissions(*PATIENT_FACTS), t.patients())


@_query
def referred_return_rate(t):
    return pat.referred_return_rate(t.admissions("patient_id", "admission_date", "outcome"))


# --- procedures, sales, schedule -------------------------------------------------------------------


@_query
def procedure_kpis(t):
    return ops.procedure_kpis(t.procedures("cost"))


@_query
def department_procedure_volume(t):
    return ops.department_procedure_volume(t.procedures("department_name"))


@_query
def procedures_per_admission(t):
    return ops.procedures_per_admission(t.procedures("admission_id"))


@_query
def volume_revenue_correlation(t):
    result = ops.volume_revenue_correlation(t.procedures("department_name", "cost"))
    return _round_columns(result, 6, "correlation")


@_query
def sales_kpis(t):
    return ops.sales_kpis(t.sales("amount"))


@_query
def sales_share_by_region(t):
    return ops.sales_share_by_region(t.sales("region", "amount"))


@_query
def schedule_kpis(t):
    return ops.schedule_kpis(t.schedule())


@_query
def schedule_frequency(t):
    return ops.station_frequency(t.schedule())


@_query
def utilisation_ratio(t):
    return ops.daily_schedule_usage(t.schedule())


# --- readmission model -----------------------------------------------------------------------------

MODEL_FACTS = (
    "admission_id",
    "patient_id",
    "department_name",
    "severity",
    "bed_type",
    "admission_type",
    "admission_date",
    "length_of_stay",
    *BILLS,
    "readmitted_30days",
    "age",
    "gender",
)


def _features(t: StarTables) -> DataFrame:
    return forest.readmission_features(t.staged_admissions(*MODEL_FACTS), staged=True)


@_query
def readmission_features(t):
    return _features(t)


@_query
def train_test_split_stratified(t):
    # Only what is returned goes through the sort.
    return forest.train_test_split_stratified(_features(t).select("admission_id", forest.LABEL))


@_query
def readmission_model(t):
    return forest.readmission_model(_features(t))


@_query
def readmission_model_check(t):
    """What must hold for any forest: every held-out admission has one prediction in range, and a walk over the
    exported nodes gives the same."""
    features = _features(t)
    # Split once for both.
    parts = forest.split_parts(features)
    walked = forest.walked_model(features, parts).select(
        F.col("admission_id").alias("_id"), F.col("prediction").alias("_class"), F.col("probability").alias("_share")
    )
    both = forest.readmission_model(features, parts).join(walked, F.col("admission_id") == F.col("_id"), "left")
    return both.select(
        "admission_id",
        forest.LABEL,
        F.col("probability").between(0, 1).alias("probability_in_range"),
        F.col("prediction").isin(0, 1).alias("prediction_valid"),
        ((F.col("prediction") == F.col("_class")) & (F.abs(F.col("probability") - F.col("_share")) < 1e-12)).alias("equals_walk"),
    )


def _given_scores(t: StarTables) -> DataFrame:
    return forest.walk(_features(t), t.spark.createDataFrame(forest_rows(), forest.NODES))


@_query
def forest_scores_of_given(t):
    """All complete admissions, scored by a walk over the nodes of a given forest."""
    return _given_scores(t).select("admission_id", forest.LABEL, "prediction", "probability")


@_query
def confusion_matrix_of_given_forest(t):
    return forest.confusion_matrix(_given_scores(t))


@_query
def code_dictionary(t):
    """The codes of all text inputs of the risk model."""
    return dictionary(t.admissions(*risk.CODES), list(risk.CODES))


@_query
def auc_of_given_score(t):
    """Area under the curve of the readmission rate of an admission's department and severity."""
    facts = t.admissions("department_name", "severity", "readmitted_30days")
    counted = facts.groupBy("department_name", "severity").agg(
        F.sum("readmitted_30days").alias("ones"), F.count(F.lit(1)).alias("n")
    )
    scored = facts.join(
        counted.select(
            F.col("department_name").alias("_d"), F.col("severity").alias("_s"), (F.col("ones") / F.col("n")).alias("score")
        ),
        F.col("department_name").eqNullSafe(F.col("_d")) & F.col("severity").eqNullSafe(F.col("_s")),
    )
    return auc_table(scored, "readmitted_30days", "score")


@_query
def model_auc(t):
    return forest.model_auc(_features(t))


def _same_area(scored: DataFrame, score: str) -> bool:
    """Whether the area from ranks is that of the library's evaluator on the exact curve; scored: label and score, staged."""
    evaluator = BinaryClassificationEvaluator(labelCol=forest.LABEL, rawPredictionCol=score, numBins=0)
    return abs(evaluator.evaluate(scored) - auc_table(scored, forest.LABEL, score).first()["auc"]) < 1e-9


@_query
def model_auc_check(t):
    """The held-out and the cross-validated areas, each found in two ways."""
    features = _features(t)

    def kept(scored: DataFrame) -> DataFrame:
        return stage(scored.select(forest.LABEL, "probability"))

    # Scored once for both ways.
    held, parts = kept(forest.readmission_model(features)), [kept(fold) for fold in forest.cross_validated(features)]
    held_out = _same_area(held, "probability")
    folds = all(_same_area(fold, "probability") for fold in parts)
    row = forest.model_auc(features, scored=(held, parts))
    return row.select(
        "admissions",
        F.col("auc").between(0, 1).alias("in_range"),
        F.lit(held_out).alias("held_out_equal"),
        F.lit(folds).alias("folds_equal"),
    )


@_query
def feature_importance(t):
    return forest.feature_importance(_features(t))


@_query
def feature_importance_check(t):
    """Every feature once, and importances of 0 or more that sum to 1."""
    table = forest.feature_importance(_features(t))
    whole = F.sum("importance").over(W.partitionBy())
    return table.select(
        "feature",
        (F.col("importance") >= 0).alias("not_negative"),
        (F.abs(whole - 1) < 1e-9).alias("sums_to_one"),
    )


@_query
def confusion_matrix(t):
    return forest.confusion_matrix(forest.readmission_model(_features(t)))


@_query
def confusion_matrix_totals(t):
    """Held-out admissions per label, which no forest changes."""
    matrix = forest.confusion_matrix(forest.readmission_model(_features(t)))
    return matrix.groupBy("actual").agg(F.sum("admissions").alias("admissions"))


@_query
def confusion_matrix_of_rule(t):
    """The same table for a rule that predicts a readmission for every urgent or unspecified case."""
    rule = F.col("severity").isin(SEVERITIES[0], SEVERITIES[3]).cast("int")
    facts = t.admissions("severity", "readmitted_30days")
    return forest.confusion_matrix(facts.withColumn("prediction", rule))


# --- segments --------------------------------------------------------------------------------------


def _patient_features(t: StarTables) -> DataFrame:
    return pat.patient_features(t.admissions(*PATIENT_FACTS), t.patients())


def _clusters(t: StarTables) -> DataFrame:
    return stage(seg.segment_patients(_patient_features(t)))


def _fixed_segments(t: StarTables) -> DataFrame:
    """Patients in four given segments, so that labels and profiles can be checked in SQL."""
    return _patient_features(t).withColumn("segment", (F.col("patient_id") % 4).cast("int"))


@_query
def segment_patients(t):
    return seg.segment_patients(_patient_features(t))


@_query
def segment_patients_check(t):
    """Every patient once, in one of four segments that are all used."""
    used = F.size(F.collect_set("segment").over(W.partitionBy()))
    return seg.segment_patients(_patient_features(t)).select(
        "patient_id", F.col("segment").between(0, 3).alias("valid"), (used == 4).alias("all_used")
    )


@_query
def segment_assignment_of_given(t):
    """Patients by the nearest of four centres, the means of given segments, with the total squared distance."""
    patients = stage(_fixed_segments(t))
    found = seg.segments_of(patients, "segment").assign(patients.drop("segment"))
    total = found.agg(round_half_up(F.sum("distance"), 2).cast("double").alias("total")).scalar()
    return found.select("patient_id", "segment", total.alias("total_cost"))


@_query
def segment_labels(t):
    return seg.segment_labels(_clusters(t))


@_query
def segment_summary(t):
    return seg.segment_summary(seg.segment_labels(_clusters(t)))


@_query
def segment_profile_minmax(t):
    return seg.segment_profile_minmax(seg.segment_labels(_clusters(t)))


@_query
def segment_summary_of_given(t):
    return seg.segment_summary(seg.segment_labels(_fixed_segments(t)))


@_query
def segment_profile_of_given(t):
    profile = seg.segment_profile_minmax(seg.segment_labels(_fixed_segments(t)))
    return _round_columns(profile, 4, *seg.PROFILE)


# --- attribution -----------------------------------------------------------------------------------

RISK_FACTS = (
    "admission_id",
    "patient_id",
    "doctor_id",
    "department_name",
    "diagnosis",
    "severity",
    "bed_type",
    "admission_type",
    "insurance_provider",
    "admission_date",
    "length_of_stay",
    "total_bill",
    "readmitted_30days",
    "outcome",
    "age",
    "gender",
    *risk.DOCTOR,
)
# Without what only the frame and the attribution name.
FIT_FACTS = tuple(c for c in RISK_FACTS if c not in ("patient_id", "doctor_id", "outcome", *risk.DOCTOR))


def _risk_frame(t: StarTables, *columns: str) -> DataFrame:
    """The frame of the model's columns and those given."""
    return risk.risk_frame(t.staged_admissions(*FIT_FACTS, *columns), staged=True)


@_query
def risk_frame(t):
    return risk.risk_frame(t.staged_admissions(*RISK_FACTS), staged=True)


@_query
def risk_model(t):
    """Calibration table: admissions and readmissions per expected probability, to 2 places."""
    scored = risk.expected_probability(_risk_frame(t))
    return (
        scored.groupBy(F.round("expected_prob", 2).alias("expected_prob"))
        .agg(
            F.count(F.lit(1)).alias("admissions"),
            F.sum("readmitted_30days").alias("readmissions"),
        )
        .orderBy("expected_prob")
    )


@_query
def risk_model_cv_auc(t):
    return risk.risk_model_cv_auc(_risk_frame(t))


@_query
def risk_model_optimality(t):
    """Per fold: whether the regression is an optimum and the calibration holds the means of pooled blocks."""
    found = risk.risk_model_optimality(_risk_frame(t))
    return found.select(
        "fold",
        (F.col("gradient") < risk.GRADIENT).alias("gradient_vanishes"),
        (F.col("off_block") < 1e-9).alias("values_are_block_means"),
        F.col("monotone"),
    )


@_query
def risk_model_cv_auc_check(t):
    """The area of each outer fold, found in two ways."""
    frame = _risk_frame(t)
    # Scored once for both ways.
    scored = [stage(fold.select(risk.LABEL, "expected_prob")) for fold in risk.cross_validated(frame)]
    folds = all(_same_area(fold, "expected_prob") for fold in scored)
    return risk.risk_model_cv_auc(frame, scored=scored).select(
        "admissions", F.col("cv_auc").between(0, 1).alias("in_range"), F.lit(folds).alias("folds_equal")
    )


@_query
def expected_probability(t):
    scored = risk.expected_probability(_risk_frame(t))
    return scored.select("admission_id", "expected_prob")


@_query
def expected_probability_check(t):
    """Every admission once with a probability, and the mean within 0.02 of the rate it predicts."""
    # Scored again for the mean, which reads features only; staged ids would take more room than the frame.
    scored = risk.expected_probability(_risk_frame(t))
    means = scored.agg((F.avg("expected_prob") - F.avg("readmitted_30days")).alias("off")).scalar()
    return scored.select(
        "admission_id",
        F.col("expected_prob").between(0, 1).alias("in_range"),
        (F.abs(means) <= 0.02).alias("calibrated"),
    )


@_query
def attribution_scores_from_model(t):
    """The whole attribution: model, expected rates, scores."""
    scored = risk.expected_probability(_risk_frame(t, "doctor_id", "outcome"))
    return att.attribution_scores(att.score_doctors(att.doctor_case_mix(scored, t.doctors())))


def _case_mix(t: StarTables) -> DataFrame:
    """Case mix with the readmission rate of the (department, severity) cell as the expected probability.

    The fact is read twice, for the cells and for the doctors, and never staged. Severity codes come with the
    cells, which are few.
    """
    facts = t.admissions(
        "doctor_id", "department_name", "severity", "readmitted_30days", "total_bill", "outcome", "age"
    )
    code = F.dense_rank().over(W.orderBy(F.asc_nulls_last("severity"))) - 1
    cells = (
        facts.groupBy("department_name", "severity")
        .agg((pct(F.sum("readmitted_30days"), F.count(F.lit(1))) / 100).alias("rate"))
        .select(
            F.col("department_name").alias("cell_department"),
            F.col("severity").alias("cell_severity"),
            F.col("rate").cast("decimal(12,8)").alias("expected_prob"),
            code.alias("severity_code"),
        )
    )
    scored = facts.join(
        cells,
        facts.department_name.eqNullSafe(cells.cell_department)
        & facts.severity.eqNullSafe(cells.cell_severity),
        "left",
    )
    return att.doctor_case_mix(scored, t.doctors())


def _scores(t: StarTables) -> DataFrame:
    return att.score_doctors(_case_mix(t))


@_query
def doctor_case_mix(t):
    return _case_mix(t)


@_query
def attribution_score(t):
    scored = att.attribution_score(stage(_case_mix(t)))
    return scored.select("doctor_id", "attribution_score_norm")


@_query
def complexity_score(t):
    return att.complexity_score(stage(_case_mix(t))).select("doctor_id", "complexity_score")


@_query
def quadrant(t):
    return _scores(t).select("doctor_id", "quadrant")


@_query
def rank_shift(t):
    return _scores(t).select("doctor_id", "raw_rank", "adj_rank", "rank_shift")


@_query
def attribution_scores(t):
    return att.attribution_scores(_scores(t))


@_query
def top_hidden_stars(t):
    return att.top_hidden_stars(_scores(t)).select("doctor_id", "complexity_score")


@_query
def top_quality_gaps(t):
    return att.top_quality_gaps(_scores(t)).select("doctor_id", "attribution_score_norm")


@_query
def top_rank_shift(t):
    return att.top_rank_shift(_scores(t)).select("doctor_id", "rank_shift")


@_query
def rank_shift_extremes(t):
    return att.rank_shift_extremes(_scores(t)).select("doctor_id", "rank_shift")


@_query
def dept_actual_vs_expected(t):
    return _round_columns(att.dept_actual_vs_expected(_scores(t)), 6, "actual", "expected")


@_query
def experience_effect(t):
    return _round_columns(
        att.experience_effect(_scores(t)), 6, "slope", "intercept", "pearson_r"
    )


@_query
def quadrant_counts(t):
    return att.quadrant_counts(_scores(t))


@_query
def complexity_extremes(t):
    return att.complexity_extremes(_scores(t))


@_query
def fold_assignment(t):
    """Admissions per cross-validation fold and label."""
    facts = t.admissions("admission_id", "readmitted_30days")
    dealt = stratified_folds(facts, "admission_id", "readmitted_30days", 5, "outer")
    return dealt.groupBy("fold", "readmitted_30days").agg(F.count(F.lit(1)).alias("admissions"))
