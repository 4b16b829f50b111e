"""Logical tables of the encounter model, with column comments for the data dictionary."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()
INT = T.IntegerType()
LONG = T.LongType()
DOUBLE = T.DoubleType()
DATE = T.DateType()
MONEY = T.DecimalType(18, 2)


def _field(name: str, dtype: T.DataType, comment: str = "") -> T.StructField:
    return T.StructField(name, dtype, True, {"comment": comment} if comment else {})


PATIENTS = T.StructType(
    [
        _field("patient_id", STRING, "key of the person"),
        _field("patient_name", STRING),
        _field("age", INT, "full years at registration"),
        _field("gender", STRING, "as stated by the person"),
        _field("blood_group", STRING),
        _field("city", STRING),
        _field("phone", STRING),
        _field("insurance", STRING, "payer on file"),
        _field("registration_date", DATE),
    ]
)

DOCTORS = T.StructType(
    [
        _field("doctor_id", STRING),
        _field("doctor_name", STRING),
        _field("department_id", STRING),
        _field("specialization", STRING),
        _field("experience_years", INT),
        _field("consultation_fee", INT),
    ]
)

ADMISSIONS = T.StructType(
    [
        _field("admission_id", STRING, "key of the stay"),
        _field("patient_id", STRING, "who stayed, see patients"),
        _field("doctor_id", STRING, "who treated, see doctors"),
        _field("department_id", STRING),
        _field("department_name", STRING, "ward that took the person in"),
        _field("diagnosis", STRING, "main reason for the stay"),
        _field("admission_date", DATE, "first day"),
        _field("discharge_date", DATE, "last day"),
        _field("length_of_stay", INT, "nights between first and last day"),
        _field("severity", STRING, "one of four grades"),
        _field("total_bill", MONEY, "charged for the stay"),
        _field("insurance_provider", STRING),
        _field("insurance_covered", MONEY, "borne by the payer"),
        _field("patient_paid", MONEY, "borne by the person"),
        _field("readmitted_30days", INT, "flag: came back within a month"),
        _field("bed_type", STRING),
        _field("admission_type", STRING),
        _field("outcome", STRING, "how the stay ended"),
    ]
)

PROCEDURES = T.StructType(
    [
        _field("procedure_id", STRING, "key of the treatment"),
        _field("admission_id", STRING),
        _field("patient_id", STRING),
        _field("department_id", STRING),
        _field("procedure_name", STRING, "what was done"),
        _field("procedure_date", DATE),
        _field("cost", MONEY, "charged for it"),
        _field("performed_by", STRING),
    ]
)

MONTHLY_REVENUE = T.StructType(
    [
        _field("year_month", STRING),
        _field("total_revenue", DOUBLE),
        _field("total_admissions", LONG),
        _field("avg_los", DOUBLE),
        _field("readmissions", LONG),
    ]
)

TABLES = {
    "admissions": ADMISSIONS,
    "patients": PATIENTS,
    "doctors": DOCTORS,
    "procedures": PROCEDURES,
    "monthly_revenue": MONTHLY_REVENUE,
}
