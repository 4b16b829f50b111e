"""The distributed ranks must equal plain windows and hand formulas, with ties, nulls and hot values."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caregauge.operators.ranking import exact_quantiles, global_position, ntile_over, rank_over
from caregauge.session import stage

DISTRIBUTED = 0  # window_rows: nothing fits one window


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = rng.random() < 1 / 3
        group = "hot" if hot else rng.choice(["a", "b", "c", None])
        value = 5.0 if rng.random() < 1 / 3 else rng.choice([None, *(x / 4 for x in range(400))])
        rows.append((i, group, value))
    return stage(spark.createDataFrame(rows, "id long, g string, v double").repartition(6))


@pytest.mark.parametrize("method", ["rank", "dense", "average"])
@pytest.mark.parametrize("groups", [(), ("g",)])
@pytest.mark.parametrize("descending", [True, False])
def test_distributed_rank_equals_window(values, method, groups, descending):
    options = dict(rows=3000, groups=groups, method=method, descending=descending)
    plain = rank_over(values, "v", "r", **options)
    spread = rank_over(values, "v", "r", window_rows=DISTRIBUTED, **options)
    assert plain.schema["r"].dataType == spread.schema["r"].dataType
    assert sorted(plain.select("id", "r").collect()) == sorted(spread.select("id", "r").collect())


def test_average_ranks_sum_to_the_triangle_number(values):
    ranked = rank_over(values, "v", "r", rows=3000, method="average", window_rows=DISTRIBUTED)
    assert ranked.agg(F.sum("r")).first()[0] == 3000 * 3001 / 2


def test_large_rank_has_no_single_task_window(values):
    ranked = rank_over(values, "v", "r", rows=3000, groups=["g"], window_rows=DISTRIBUTED)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    # The only window left orders the rows of one range partition, or the list of partitions.
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line or "_rows" in line for line in windows)


@pytest.mark.parametrize("n, tiles", [(1500, 10), (1503, 10), (7, 10), (10, 10), (1, 4)])
def test_ntile_equals_window(spark, n, tiles):
    df = spark.range(n).withColumn("v", F.col("id") % 37).repartition(5)
    order = [F.desc("v"), F.asc("id")]
    ours = ntile_over(df, order, tiles, "t").select("id", "t").collect()
    plain = df.select("id", F.ntile(tiles).over(W.orderBy(*order)).alias("t")).collect()
    assert sorted(ours) == sorted(plain)


def test_global_position_is_dense_from_zero(spark):
    placed = global_position(spark.range(1000).repartition(7), [F.desc("id")])
    assert {(r.id, r._row) for r in placed.collect()} == {(i, 999 - i) for i in range(1000)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
def test_exact_quantiles_equal_percentile(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([rng.random(), 0.5]),) for _ in range(n)] + [(None,)]
    df = spark.createDataFrame(rows, "v double")
    names = ["q75", "q50", "q10"]
    built_in = exact_quantiles(df, "v", [0.75, 0.5, 0.1], names, rows=n)
    spread = exact_quantiles(df, "v", [0.75, 0.5, 0.1], names, rows=n, window_rows=DISTRIBUTED)
    assert spread.first().asDict() == pytest.approx(built_in.first().asDict(), rel=1e-14)


def test_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    for limit in (DISTRIBUTED, 10):
        assert exact_quantiles(df, "v", [0.5], ["m"], rows=1, window_rows=limit).first().m is None
