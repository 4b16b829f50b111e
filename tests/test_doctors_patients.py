import pytest
from pyspark.sql import functions as F

from caregauge.operators import doctors as doc
from caregauge.operators import patients as pat

from .conftest import by

WINDOWS = [1_000_000, 0]  # plain windows, distributed ranks


@pytest.mark.parametrize("window_rows", WINDOWS)
def test_scorecard_drops_idle_doctors_and_ranks_within_specialization(doctors, admissions, window_rows):
    rows = by(doc.doctor_scorecard(doctors, admissions, window_rows).collect(), "doctor_name")
    assert set(rows) == {"Dr. Rao A", "Dr. Rao B", "Dr. Sen A"}
    assert rows["Dr. Rao A"]["total_revenue_generated"] == 400.10
    assert rows["Dr. Rao A"]["recovery_rate_pct"] == 33.3
    assert (rows["Dr. Rao A"]["dept_revenue_rank"], rows["Dr. Rao A"]["dept_recovery_rank"]) == (1, 2)
    assert rows["Dr. Sen A"]["dept_revenue_rank"] == 1


def test_api_doctors_keeps_idle_doctors(doctors, admissions):
    rows = doc.api_doctors(doctors, admissions).collect()
    assert [r.doctor_name for r in rows] == ["Dr. Sen A", "Dr. Rao A", "Dr. Rao B", "Dr. Idle"]
    idle = rows[-1]
    assert (idle.patients, idle.revenue, idle.recovery_rate, idle.readmissions) == (0, None, 0.0, None)
    assert doc.api_doctors(doctors, admissions, top=2).count() == 2


@pytest.mark.parametrize("window_rows", WINDOWS)
def test_productivity_rounds_months_first(doctors, admissions, window_rows):
    rows = by(doc.doctor_monthly_productivity(doctors, admissions, window_rows).collect(), "doctor_name")
    rao = rows["Dr. Rao A"]
    assert (rao["total_revenue"], rao["active_months"], rao["avg_monthly_revenue"]) == (400.0, 2, 200.0)
    assert rao["rank_in_dept"] == 1 and rows["Dr. Rao B"]["rank_in_dept"] == 2
    assert "Dr. Idle" not in rows


def test_productivity_merges_equal_names(doctors, admissions):
    same = doctors.withColumn("doctor_name", F.lit("Dr. X"))
    rows = by(doc.doctor_monthly_productivity(same, admissions).collect(), "specialization")
    assert rows["Cardio"]["total_patients"] == 5 and rows["Cardio"]["active_months"] == 4


@pytest.mark.parametrize("window_rows", WINDOWS)
def test_tiers_compare_strictly_with_all_doctors(doctors, admissions, window_rows):
    rows = by(doc.report_doctor_tiers(doctors, admissions, window_rows=window_rows).collect(), "doctor_name")
    # revenues 1200.20, 400.10, 210.00: upper quartile 800.15, median 400.10
    assert {k: r["performance"] for k, r in rows.items()} == {
        "Dr. Sen A": "Top", "Dr. Rao A": "Avg", "Dr. Rao B": "Avg",
    }
    assert doc.report_doctor_tiers(doctors, admissions, top=1, window_rows=window_rows).count() == 1


def test_visit_cohorts(admissions):
    rows = by(pat.visit_cohorts(admissions).collect(), "visit_segment")
    assert rows["1 Visit (One-time)"]["patients_in_segment"] == 1
    assert rows["2 Visits"]["avg_lifetime_value"] == 800.0
    assert rows["5+ Visits (High Value)"]["avg_spend_per_visit"] == 92.0
    assert sum(r["patients_in_segment"] for r in rows.values()) == 3


def test_patient_visits(admissions):
    row = by(pat.patient_visits(admissions).collect(), "patient_id")["P1"]
    assert (str(row["first_visit"]), str(row["last_visit"]), row["total_visits"]) == ("2021-01-05", "2022-06-02", 5)
    assert float(row["avg_spend_per_visit"]) == 92.07


def test_null_age_is_elderly_and_unknown_patients_drop(admissions, patients):
    rows = by(pat.age_group_profile(admissions, patients).collect(), "age_group")
    assert set(rows) == {"0–17 Pediatric", "35–54 Middle Age", "70+ Elderly"}
    assert rows["70+ Elderly"]["admissions"] == 2 and rows["70+ Elderly"]["unique_patients"] == 1
    assert rows["0–17 Pediatric"]["critical_cases"] == 1
    fewer = patients.where("patient_id <> 'P1'")
    assert "35–54 Middle Age" not in by(pat.age_group_profile(admissions, fewer).collect(), "age_group")


def test_deciles(spark):
    df = spark.range(25).selectExpr("id AS patient_id", "cast(100 - id AS double) AS total_bill")
    rows = pat.spend_deciles(df).collect()
    assert [r.patients for r in rows] == [3, 3, 3, 3, 3, 2, 2, 2, 2, 2]
    assert rows[0].avg_spend == 99.0
    assert sum(r.pct_of_total_revenue for r in rows) == pytest.approx(100, abs=0.05)


def test_features_drop_patients_without_age(admissions, patients):
    rows = by(pat.patient_features(admissions, patients).collect(), "patient_id")
    assert set(rows) == {"P1", "P3"}
    assert rows["P1"] == {
        "patient_id": "P1", "total_spend": 460.35, "visits": 5, "avg_los": 5.0, "readmissions": 2, "age": 40,
    }


def test_referred_return(admissions):
    row = pat.referred_return_rate(admissions).first()
    # A2 (P1) is followed, A5 (P3) is not
    assert (row.referred_admissions, row.returned, row.return_rate_pct) == (2, 1, 50.0)
    assert pat.referred_return_rate(admissions.where("outcome = 'Recovered'")).first().return_rate_pct is None
