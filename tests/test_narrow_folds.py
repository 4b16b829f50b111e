"""What the sort that deals folds carries, and fits side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from caregauge.operators import learning, ranking
from caregauge.operators import risk_model as risk
from caregauge.operators import segmentation as seg
from caregauge.session import stage


def test_folds_stage_no_hashes(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(ranking, "stage", lambda df: staged.append(df) or stage(df))
    dealt = learning.stratified_folds(spark.range(100).withColumn("y", F.col("id") % 2), "id", "y", 5, "s")
    assert staged[0].columns == ["id", "y", "_id"] and dealt.columns == ["id", "y", "fold"]
    (shuffled,) = [
        line for line in staged[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line
    ]
    below = staged[0]._jdf.queryExecution().optimizedPlan().toString().split(shuffled)[1]
    assert "_place" not in below and "_rest" not in below


@pytest.mark.parametrize("module, name", [(seg, "KMeans"), (risk, "LogisticRegression")])
def test_fits_run_side_by_side(spark, monkeypatch, module, name):
    """Each of two fits waits for the other to begin."""
    both = threading.Barrier(2, timeout=60)
    real = getattr(module, name)

    class Met(real):
        def fit(self, *rows):
            both.wait()
            return super().fit(*rows)

    monkeypatch.setattr(module, name, Met)
    if module is seg:
        df = stage(spark.range(60).selectExpr("id patient_id", *(f"double(id % {i + 3}) {c}" for i, c in enumerate(seg.FEATURES))))
        assert len(seg.fit_segments(df, k=2, restarts=2).centres) == 2
    else:
        df = stage(spark.range(60).selectExpr("id admission_id", "int(id % 2) readmitted_30days", *(f"double(id % {i + 3}) {c}" for i, c in enumerate(risk.FEATURES))))
        assert len(risk.fit_risk_model(df, folds=2).pairs) == 2
