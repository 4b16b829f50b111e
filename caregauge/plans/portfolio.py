"""Every hospital query by name, with the standard thresholds, over a HospitalTables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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
from ..operators.dictionary import data_dictionary
from ..session import stage
from ..sources.hospital import HospitalTables

SEVERITIES = ("Mild", "Moderate", "Severe", "Critical")
YEARS = (2021, 2022, 2023, 2024)


def _features(t: HospitalTables) -> DataFrame:
    return forest.readmission_features(t.admissions, t.patients)


def _segments(t: HospitalTables) -> DataFrame:
    clusters = seg.segment_patients(pat.patient_features(t.admissions, t.patients))
    return seg.segment_labels(stage(clusters))


def _expected(t: HospitalTables) -> DataFrame:
    return risk.expected_probability(risk.risk_frame(t.admissions, t.patients, t.doctors))


def _with_department_names(t: HospitalTables) -> DataFrame:
    """Procedures carry the department's id only; its name is taken from the admissions."""
    names = t.admissions.groupBy("department_id").agg(F.min("department_name").alias("department_name"))
    return t.procedures.join(names, "department_id", "left")


def doctor_scores(t: HospitalTables) -> DataFrame:
    """Risk model and attribution in one go; the reports in REPORTS_ON_SCORES read its result."""
    return att.score_doctors(att.doctor_case_mix(_expected(t), t.doctors))


QUERIES: dict[str, Callable[[HospitalTables], DataFrame]] = {
    # rankings, trends and cohorts
    "dept_revenue_ranking": lambda t: dep.dept_revenue_ranking(t.admissions),
    "monthly_mom_growth": lambda t: trends.monthly_mom_growth(t.admissions),
    "readmission_by_dept_severity": lambda t: dep.readmission_by_dept_severity(t.admissions),
    "doctor_scorecard": lambda t: doc.doctor_scorecard(t.doctors, t.admissions),
    "insurer_leakage": lambda t: dep.insurer_leakage(t.admissions),
    "visit_cohorts": lambda t: pat.visit_cohorts(t.admissions),
    "rolling_and_cumulative": lambda t: trends.rolling_and_cumulative(t.admissions),
    "top_procedures": lambda t: dep.top_procedures(t.procedures, t.admissions),
    "bed_utilisation": lambda t: dep.bed_utilisation(t.admissions),
    "age_group_profile": lambda t: pat.age_group_profile(t.admissions, t.patients),
    "yoy_pivot": lambda t: dep.yoy_pivot(t.admissions, YEARS),
    "spend_deciles": lambda t: pat.spend_deciles(t.admissions),
    "diagnosis_rank": lambda t: dep.diagnosis_rank(t.admissions),
    "doctor_monthly_productivity": lambda t: doc.doctor_monthly_productivity(t.doctors, t.admissions),
    "executive_kpis": lambda t: kpis.executive_kpis(t.admissions),
    # dashboard endpoints
    "api_kpis": lambda t: kpis.api_kpis(t.admissions),
    "api_monthly": lambda t: trends.api_monthly(t.admissions),
    "api_departments": lambda t: dep.api_departments(t.admissions),
    "api_yoy": lambda t: trends.api_yoy(t.admissions),
    "api_severity": lambda t: kpis.frequency_table(t.admissions, "severity"),
    "api_outcomes": lambda t: kpis.frequency_table(t.admissions, "outcome"),
    "api_insurance": lambda t: dep.api_insurance(t.admissions),
    "api_doctors": lambda t: doc.api_doctors(t.doctors, t.admissions),
    "api_readmission_heatmap": lambda t: dep.readmission_heatmap(t.admissions),
    "api_bed_types": lambda t: kpis.frequency_table(t.admissions, "bed_type"),
    # report tables
    "monthly_revenue_rollup": lambda t: trends.monthly_revenue_rollup(t.admissions),
    "report_dept_summary": lambda t: dep.report_dept_summary(t.admissions),
    "report_dept_total_row": lambda t: dep.report_dept_total_row(dep.report_dept_summary(t.admissions)),
    "report_monthly": lambda t: trends.report_monthly(t.admissions),
    "report_doctor_tiers": lambda t: doc.report_doctor_tiers(t.doctors, t.admissions),
    "report_diagnosis_top": lambda t: dep.report_diagnosis_top(t.admissions),
    "data_dictionary": lambda t: data_dictionary(t.admissions.sparkSession),
    # analysis frames
    "kpi_overview": lambda t: kpis.kpi_overview(t.admissions),
    "monthly_trend_line": lambda t: trends.monthly_trend_line(t.admissions),
    "department_matrix": lambda t: dep.department_matrix(t.admissions),
    "readmission_severity_pivot": lambda t: dep.readmission_severity_pivot(t.admissions, SEVERITIES),
    "insurance_breakdown": lambda t: dep.insurance_breakdown(t.admissions),
    "patient_features": lambda t: pat.patient_features(t.admissions, t.patients),
    "segment_patients": _segments,
    "segment_summary": lambda t: seg.segment_summary(_segments(t)),
    "segment_profile_minmax": lambda t: seg.segment_profile_minmax(_segments(t)),
    "readmission_features": _features,
    "readmission_model": lambda t: forest.readmission_model(_features(t)),
    "model_auc": lambda t: forest.model_auc(_features(t)),
    "feature_importance": lambda t: forest.feature_importance(_features(t)),
    "confusion_matrix": lambda t: forest.confusion_matrix(forest.readmission_model(_features(t))),
    # attribution
    "risk_frame": lambda t: risk.risk_frame(t.admissions, t.patients, t.doctors),
    "risk_model_cv_auc": lambda t: risk.risk_model_cv_auc(
        risk.risk_frame(t.admissions, t.patients, t.doctors)
    ),
    "expected_probability": _expected,
    "attribution_scores": lambda t: att.attribution_scores(doctor_scores(t)),
    # procedures and outcomes
    "procedure_kpis": lambda t: ops.procedure_kpis(t.procedures),
    "department_procedure_volume": lambda t: ops.department_procedure_volume(
        _with_department_names(t)
    ),
    "procedures_per_admission": lambda t: ops.procedures_per_admission(t.procedures),
    "volume_revenue_correlation": lambda t: ops.volume_revenue_correlation(
        _with_department_names(t)
    ),
    "success_rate_vs_benchmark": lambda t: dep.success_rate_vs_benchmark(t.admissions),
    "referred_return_rate": lambda t: pat.referred_return_rate(t.admissions),
}

REPORTS_ON_SCORES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "top_hidden_stars": att.top_hidden_stars,
    "top_quality_gaps": att.top_quality_gaps,
    "top_rank_shift": att.top_rank_shift,
    "rank_shift_extremes": att.rank_shift_extremes,
    "dept_actual_vs_expected": att.dept_actual_vs_expected,
    "experience_effect": att.experience_effect,
    "quadrant_counts": att.quadrant_counts,
    "complexity_extremes": att.complexity_extremes,
}


def run(name: str, tables: HospitalTables) -> DataFrame:
    if name in REPORTS_ON_SCORES:
        return REPORTS_ON_SCORES[name](doctor_scores(tables))
    return QUERIES[name](tables)
