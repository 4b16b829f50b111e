"""All hospital queries with their standard thresholds, over tables read from CSV."""

import random

import pytest

from caregauge.__main__ import main
from caregauge.plans import portfolio
from caregauge.sources.hospital import load_tables
from caregauge.sources.schemas import ADMISSIONS, TABLES

DEPARTMENTS = ["Cardiology", "Neurology", "Urology"]


def _admissions(rng: random.Random) -> list[str]:
    rate = {"Mild": 0.0, "Moderate": 0.1, "Severe": 0.4, "Critical": 0.6}
    lines = []
    for i in range(900):
        department = rng.randrange(3)
        severity = rng.choice(list(rate))
        stay, bill = rng.randint(1, 9), rng.randint(100_000, 9_000_000)
        covered = bill * rng.randint(0, 80) // 100
        year, month, day = 2021 + i % 4, 1 + i % 12, 1 + i % 28
        cells = [
            f"ADM{i:05d}", f"PAT{rng.randrange(250)}", f"DOC{department}{rng.randrange(4)}", f"D{department}",
            DEPARTMENTS[department], f"Diagnosis {department}{rng.randrange(3)}",
            f"{year}-{month:02d}-{day:02d}", f"{year}-{month:02d}-{day:02d}", stay, severity,
            f"{bill / 100:.2f}", rng.choice(["Alpha", "Self-Pay"]), f"{covered / 100:.2f}",
            f"{(bill - covered) / 100:.2f}", int(rng.random() < rate[severity]),
            rng.choice(["ICU", "General"]), rng.choice(["Urgent", "Elective"]),
            rng.choice(["Recovered", "Improved", "Referred"]),
        ]
        lines.append(",".join(map(str, cells)))
    return lines


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    rows = {
        "admissions": _admissions(rng),
        "patients": [f"PAT{i},Name,{rng.randint(1, 85)},Male,A+,City,9,Alpha,2021-01-01" for i in range(250)],
        "doctors": [f"DOC{d}{i},Dr. {d}{i},D{d},{DEPARTMENTS[d]},{3 + i},500" for d in range(3) for i in range(4)],
        "procedures": [
            f"PROC{i},ADM{rng.randrange(900):05d},PAT1,D{i % 3},ECG,2021-01-01,{rng.randint(10, 99)}.50,DOC00"
            for i in range(500)
        ],
    }
    path = tmp_path_factory.mktemp("hospital")
    for name, lines in rows.items():
        header = ",".join(TABLES[name].fieldNames())
        (path / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, folder):
    return load_tables(spark, folder, "csv")


HEAVY = {
    "segment_profile_minmax", "segment_summary", "model_auc", "confusion_matrix", "feature_importance",
    "risk_model_cv_auc", "expected_probability", "readmission_model",
}


def test_csv_types(tables):
    assert tables.admissions.schema.simpleString() == ADMISSIONS.simpleString()
    assert tables.admissions.where("admission_date is null or total_bill is null").count() == 0


@pytest.mark.parametrize("name", sorted(set(portfolio.QUERIES) - HEAVY))
def test_query_gives_rows(tables, name):
    rows = portfolio.run(name, tables).collect()
    assert rows
    assert any(value is not None for value in rows[0])


def test_reports_read_one_set_of_scores(tables):
    scores = portfolio.doctor_scores(tables)
    assert scores.count() == 12
    for report in portfolio.REPORTS_ON_SCORES.values():
        report(scores).collect()
    counts = portfolio.REPORTS_ON_SCORES["quadrant_counts"](scores).collect()
    assert sum(r.doctors for r in counts) == 12


def test_command_line_writes_results(spark, folder, tmp_path):
    for fmt in ("csv", "json", "parquet"):
        out = str(tmp_path / fmt)
        main(["--tables", folder, "--format", "csv", "--out", out, "--write", fmt, "api_departments", "api_yoy"])
    assert spark.read.parquet(f"{tmp_path}/parquet/api_departments").count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/api_yoy").count() == 4
    assert spark.read.json(f"{tmp_path}/json/api_departments").select("department_name").count() == 3
