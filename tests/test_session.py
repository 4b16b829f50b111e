import datetime as dt
import os

import time

import pytest

from caregauge import session
from caregauge.session import shared_folder, stage, staging
from caregauge.sources.hospital import load_tables_jdbc
from caregauge.sources.io import date_predicates, prefix_predicates


def folders(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_staged_tables_go_with_their_scope(spark):
    before = folders(spark)
    with staging(spark):
        table = stage(spark.range(10))
        assert table.count() == 10 and folders(spark) != before
    assert folders(spark) == before


def test_scope_ends_after_an_error_and_leaves_other_tables(spark):
    kept = stage(spark.range(3))
    before = folders(spark)
    with pytest.raises(ValueError), staging(spark):
        stage(spark.range(10)).count()
        raise ValueError
    assert folders(spark) == before and kept.count() == 3


def matches(condition, day):
    """Evaluate one date condition on a value as a database would."""
    text = condition.replace("d IS NULL", "False" if day else "True").replace("AND", "and").replace("OR", "or")
    return bool(eval(text, {"d": day or ""})) if day else "True" in text


def test_date_parts_cover_every_row_once():
    parts = date_predicates("d", dt.date(2021, 1, 1), dt.date(2021, 12, 31), 4)
    assert len(parts) == 4
    for day in ("2019-05-05", "2021-01-01", "2021-04-02", "2021-08-08", "2021-12-31", "2030-01-01"):
        assert sum(matches(p, day) for p in parts) == 1
    assert sum("IS NULL" in p for p in parts) == 1
    assert date_predicates("d", dt.date(2021, 1, 1), dt.date(2021, 1, 1), 4) == ["1 = 1"]
    assert prefix_predicates("d", ["PAT2", "PAT1"]) == [
        "d < 'PAT1' OR d IS NULL", "d >= 'PAT1' AND d < 'PAT2'", "d >= 'PAT2'",
    ]


def test_jdbc_load_passes_the_parts_of_each_table(spark, monkeypatch, admissions):
    calls = {}

    class Reader:
        def jdbc(self, url, table, predicates, properties):
            calls[table] = (url, predicates, properties)
            return admissions

        def format(self, _):
            return self

        def options(self, **options):
            calls[options["dbtable"]] = (options["url"], None, options)
            return self

        def load(self):
            return admissions

    class Session:
        read = Reader()

    load_tables_jdbc(Session(), "jdbc:x", splits={"admissions": ["a", "b"]}, user="u")
    assert calls["admissions"][:2] == ("jdbc:x", ["a", "b"])
    assert calls["admissions"][2]["user"] == "u" and calls["patients"][1] is None


def test_shuffle_files_of_a_long_job_go_when_it_ends(spark, monkeypatch):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    monkeypatch.setattr(session, "LONG_JOB", 0)
    session.release(spark)
    time.sleep(5)
    before = blocks.getAllBlocks().size()
    staged = session.stage(spark.range(5000).repartition(40))
    until = time.monotonic() + 20
    while blocks.getAllBlocks().size() > before and time.monotonic() < until:
        time.sleep(0.2)
    assert blocks.getAllBlocks().size() <= before
    assert staged.count() == 5000
