from __future__ import annotations

import datetime as dt

import pytest

from caregauge.session import build_session

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


# admission, patient, doctor, department, diagnosis, date, stay, severity, bill, insurer, covered,
# readmitted, bed, type, outcome
ADMISSION_ROWS = [
    ("A1", "P1", "D1", "Cardio", "Angina", "2021-01-05", 2, "Mild", 100.10, "Alpha", 50.05, 0, "ICU", "Urgent", "Recovered"),
    ("A2", "P1", "D1", "Cardio", "Angina", "2021-01-20", 4, "Severe", 300.00, "Beta", 240.00, 1, "ICU", "Urgent", "Referred"),
    ("A3", "P2", "D2", "Cardio", "Hypertension", "2021-02-01", 3, "Mild", 200.00, "Self-Pay", 0.00, 0, "General", "Elective", "Improved"),
    ("A4", "P2", "D3", "General", "Hypertension", "2021-04-10", 1, "Mild", 600.10, "Alpha", 100.00, 0, "General", "Urgent", "Recovered"),
    ("A5", "P3", "D3", "General", "Flu", "2022-04-11", 5, "Critical", 600.10, "Alpha", 500.00, 1, "Private", "Urgent", "Referred"),
    ("A6", "P1", "D1", "General", "Flu", "2022-05-01", 6, "Moderate", 0.00, "Beta", 0.00, 1, "Private", "Elective", "Expired"),
    ("A7", "P1", "DX", "General", "Flu", "2022-05-02", 6, "Moderate", 50.25, "Beta", 10.00, 0, "Private", "Elective", "Recovered"),
    ("A8", "P1", "D2", None, "Flu", "2022-06-02", 7, "Moderate", 10.00, None, 10.00, 0, "Private", "Elective", "Recovered"),
]


@pytest.fixture(scope="session")
def admissions(spark):
    columns = (
        "admission_id string, patient_id string, doctor_id string, department_name string,"
        " diagnosis string, admission_date date, length_of_stay int, severity string,"
        " total_bill double, insurance_provider string, insurance_covered double,"
        " patient_paid double, readmitted_30days int, bed_type string, admission_type string,"
        " outcome string"
    )
    data = [
        (*r[:5], day(r[5]), *r[6:11], round(r[8] - r[10], 2), *r[11:]) for r in ADMISSION_ROWS
    ]
    return spark.createDataFrame(data, columns)


@pytest.fixture(scope="session")
def patients(spark):
    return spark.createDataFrame(
        [("P1", 40, "Female"), ("P2", None, None), ("P3", 17, "Male"), ("P9", 70, "Male")],
        "patient_id string, age int, gender string",
    )


@pytest.fixture(scope="session")
def doctors(spark):
    return spark.createDataFrame(
        [
            ("D1", "Dr. Rao A", "Cardio", 4),
            ("D2", "Dr. Rao B", "Cardio", 9),
            ("D3", "Dr. Sen A", "General", 20),
            ("D4", "Dr. Idle", "General", 1),
        ],
        "doctor_id string, doctor_name string, specialization string, experience_years int",
    )


@pytest.fixture(scope="session")
def procedures(spark):
    return spark.createDataFrame(
        [
            ("X1", "A1", "Cardio", "ECG", 10.00),
            ("X2", "A1", "Cardio", "Stent", 90.00),
            ("X3", "A2", "Cardio", "ECG", 12.50),
            ("X4", "A4", "General", "ECG", 11.00),
            ("X5", "gone", "General", "ECG", 99.00),
        ],
        "procedure_id string, admission_id string, department_name string, procedure_name string,"
        " cost double",
    )


def by(rows, *keys):
    """Rows as dicts, keyed by one or more columns."""
    return {
        (r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r.asDict() for r in rows
    }
