import json

import pytest

from caregauge.operators import operations as ops
from caregauge.operators.dictionary import data_dictionary
from caregauge.sources import (
    jdbc_options,
    jdbc_write_options,
    json_records,
    read_query,
    read_table,
    replace_statements,
    row_counts,
    with_date_parts,
    write_csv,
    write_parts,
    write_table,
    write_table_jdbc,
)
from caregauge.sources.schemas import ADMISSIONS, TABLES

from .conftest import by


def test_procedure_kpis_do_not_fan_out(procedures):
    row = ops.procedure_kpis(procedures).first()
    assert (row.total_procedures, row.total_cost, row.avg_cost) == (5, 222.5, 44.5)


def test_volume_and_histogram(procedures):
    assert [(r.department_name, r.procedures, r.volume_rank) for r in ops.department_procedure_volume(procedures).collect()] == [
        ("Cardio", 3, 1), ("General", 2, 2),
    ]
    assert [(r.procedures, r.admissions) for r in ops.procedures_per_admission(procedures).collect()] == [(1, 3), (2, 1)]
    assert ops.volume_revenue_correlation(procedures).first().correlation == pytest.approx(1.0)


def test_sales(spark):
    sales = spark.createDataFrame([("N", 40.0), ("N", 0.0), ("S", 40.0), ("E", 20.0)], "region string, amount double")
    row = ops.sales_kpis(sales).first()
    assert (row.total_sales, row.transactions, row.avg_sale, row.max_sale) == (100.0, 4, 25.0, 40.0)
    assert [(r.region, r.share_pct) for r in ops.sales_share_by_region(sales).collect()] == [("N", 40.0), ("S", 40.0), ("E", 20.0)]


def test_schedule(spark):
    schedule = spark.createDataFrame(
        [("x", 1, "2021-01-01"), ("x", 1, "2021-01-01"), ("x", 2, "2021-01-02"), ("y", 2, "2021-01-02")],
        "station string, train int, day string",
    )
    row = ops.schedule_kpis(schedule).first()
    assert (row.trains, row.stations, row.schedules) == (2, 2, 4)
    assert [(r.station, r.schedules, r.trains, r.share_pct) for r in ops.station_frequency(schedule).collect()] == [
        ("x", 3, 2, 75.0), ("y", 1, 1, 25.0),
    ]
    assert [r.utilisation for r in ops.daily_schedule_usage(schedule).collect()] == [0.5, 1.0]


def test_utilisation_of_zero_capacity_is_null(spark):
    df = spark.createDataFrame([(3, 0), (3, 4)], "used int, seats int")
    assert [r.utilisation for r in ops.utilisation_ratio(df, "used", "seats").collect()] == [None, 0.75]


def test_csv_keeps_types(spark, tmp_path, admissions):
    path = str(tmp_path / "csv")
    write_csv(admissions, path)
    write_csv(admissions, path)  # replaces
    back = read_table(spark, "csv", path, schema=admissions.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, admissions.collect()))
    with pytest.raises(ValueError):
        read_table(spark, "csv", path)


def test_csv_reads_iso_dates_and_money(spark, tmp_path):
    path = tmp_path / "a.csv"
    header = ",".join(ADMISSIONS.fieldNames())
    path.write_text(header + "\nADM1,P1,D1,D01,Cardio,Angina,2021-01-31,2021-02-02,2,Mild,10.05,X,1.00,9.05,0,ICU,Urgent,Recovered\n")
    row = read_table(spark, "csv", str(path), schema=ADMISSIONS).first()
    assert str(row.admission_date) == "2021-01-31" and str(row.total_bill) == "10.05"


def test_table_is_replaced_and_partitioned(spark, tmp_path, admissions):
    path = str(tmp_path / "t")
    write_table(admissions, path)
    write_table(admissions.limit(2), path, partition_by=["bed_type"])
    assert read_table(spark, "parquet", path).count() == 2


def test_jdbc_options():
    whole = jdbc_options("jdbc:x:y", table="admissions", partition_column="id", bounds=(0, 100), partitions=8)
    assert whole["numPartitions"] == "8" and whole["upperBound"] == "100" and "query" not in whole
    assert jdbc_options("jdbc:x:y", query="SELECT 1")["query"] == "SELECT 1"
    for wrong in (
        dict(),
        dict(table="t", query="q"),
        dict(query="q", partition_column="id"),
        dict(table="t", partition_column="id"),
    ):
        with pytest.raises(ValueError):
            jdbc_options("jdbc:x:y", **wrong)


class Connection:
    """Records statements; stands for a database, as none may be started here."""

    def __init__(self, staged=None, fail=None):
        self.log, self.staged, self.fail = [], staged, fail

    def cursor(self):
        return self

    def execute(self, sql):
        self.log.append(sql)
        if self.fail and sql.startswith(self.fail):
            raise OSError("lost")

    def fetchone(self):
        return (self.staged,)

    def commit(self):
        self.log.append("COMMIT")

    def rollback(self):
        self.log.append("ROLLBACK")

    def close(self):
        self.log.append("close")


def shape(log):
    return [line.split(" ")[0] for line in log]


def test_jdbc_write_options():
    options = jdbc_write_options("jdbc:x:y", "clinic.admissions", 500, 4, truncate=True, column_types="a INT")
    assert options["batchsize"] == "500" and options["numPartitions"] == "4" and options["truncate"] == "true"
    assert options["dbtable"] == "clinic.admissions" and options["createTableColumnTypes"] == "a INT"
    assert "createTableColumnTypes" not in jdbc_write_options("u", "t") and jdbc_write_options("u", "t")["truncate"] == "false"
    for wrong in (dict(table="t; DROP TABLE u"), dict(table=""), dict(table="t", batch_size=0), dict(table="t", connections=0)):
        with pytest.raises(ValueError):
            jdbc_write_options("u", **wrong)


def test_jdbc_replace_is_one_transaction_after_the_rows_are_counted(spark):
    df = spark.range(100).selectExpr("id", "id AS `odd\"name`")
    written, connection = [], Connection(staged=100)

    def save(frame, options):
        written.append((frame.collect(), options))

    assert write_table_jdbc(df, "jdbc:x:y", "t", lambda: connection, properties={"user": "u"}, save=save) == 100
    ((rows, options),) = written
    staging = options["dbtable"]
    assert len(rows) == 100 and staging.startswith("t_staging_") and options["user"] == "u" and options["batchsize"] == "10000"
    names = '"id", "odd""name"'
    assert [line for line in connection.log if line != "close"] == [
        f"SELECT count(*) FROM {staging}",
        "DELETE FROM t",
        f"INSERT INTO t ({names}) SELECT {names} FROM {staging}",
        "COMMIT",
        f"DROP TABLE IF EXISTS {staging}",
        "COMMIT",
    ]
    assert replace_statements("t", "s", ["a"], True, "`") == ["TRUNCATE TABLE t", "INSERT INTO t (`a`) SELECT `a` FROM s"]


@pytest.mark.parametrize(
    "connection, error",
    [(Connection(staged=101), RuntimeError), (Connection(staged=100, fail="INSERT"), OSError), (Connection(staged=100, fail="DELETE"), OSError)],
)
def test_jdbc_failures_leave_the_table(spark, connection, error):
    with pytest.raises(error):
        write_table_jdbc(spark.range(100).toDF("id"), "u", "t", lambda: connection, save=lambda f, o: f.collect())
    log = [x for x in shape(connection.log) if x != "close"]
    assert log[-2:] == ["DROP", "COMMIT"] and "ROLLBACK" in log and "COMMIT" not in log[:-1]


def test_jdbc_failed_write_drops_the_staging_table_only(spark):
    connection = Connection()

    def save(frame, options):
        raise OSError("executor lost")

    with pytest.raises(OSError):
        write_table_jdbc(spark.range(3).toDF("id"), "u", "t", lambda: connection, save=save)
    assert [x for x in shape(connection.log) if x != "close"] == ["DROP", "COMMIT"]


def test_parts_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "months")
    schema = "value int, month string"

    def read():
        return sorted(tuple(r) for r in read_table(spark, "parquet", path, schema=spark.createDataFrame([], schema).schema).collect())

    write_parts(spark.createDataFrame([(1, "2021-01"), (2, "2021-02"), (3, "2021-03")], schema), path, ["month"])
    write_parts(spark.createDataFrame([(20, "2021-02"), (40, "2021-04")], schema), path, ["month"])
    assert read() == [(1, "2021-01"), (3, "2021-03"), (20, "2021-02"), (40, "2021-04")]
    write_parts(spark.createDataFrame([], schema), path, ["month"])
    before = read()
    broken = spark.range(8).selectExpr("cast(if(id = 7, raise_error('lost'), id) as int) AS value", "'2021-01' AS month")
    with pytest.raises(Exception, match="lost"):
        write_parts(broken.repartition(4), path, ["month"])
    assert read() == before


def test_query_counts_json_dates(spark, admissions, patients):
    assert read_query(spark, "SELECT count(*) AS n FROM {a} WHERE bed_type = 'ICU'", a=admissions).first().n == 2
    counts = row_counts({"admissions": admissions, "patients": patients})
    assert {(r.table_name, r.row_count) for r in counts.collect()} == {("admissions", 8), ("patients", 4)}
    records = [json.loads(r.record) for r in json_records(patients.orderBy("patient_id")).collect()]
    assert records[0] == {"patient_id": "P1", "age": 40, "gender": "Female"}
    parts = with_date_parts(spark.createDataFrame([("2021-03-09",)], "d string"), "d").first()
    assert (str(parts.d), parts.year, parts.month, parts.year_month) == ("2021-03-09", 2021, 3, "2021-03")


def test_dictionary_lists_documented_columns(spark):
    rows = by(data_dictionary(spark).collect(), "table_name", "column_name")
    assert len(rows) == 21
    assert rows["admissions", "total_bill"]["data_type"] == "decimal(18,2)"
    assert all(t in TABLES for t, _ in rows)
