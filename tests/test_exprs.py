import pytest
from pyspark.sql import functions as F

from caregauge import functions as fx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_half_up_is_not_fooled_by_binary_fractions(spark):
    assert value(spark, fx.rounded(F.lit(1.005), 2)) == 1.01
    assert value(spark, fx.rounded(F.lit(-2.5), 0)) == -3.0
    assert value(spark, fx.rounded(F.lit(None).cast("double"), 0)) is None


@pytest.mark.parametrize("x, digits, expected", [(0.5, 0, 0.0), (1.5, 0, 2.0), (0.0625, 3, 0.062), (-2.5, 0, -2.0)])
def test_half_even(spark, x, digits, expected):
    assert value(spark, fx.round_half_even(F.lit(x), digits)) == expected


def test_zero_divisors_give_null(spark):
    assert value(spark, fx.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, fx.pct(F.lit(0), F.lit(0))) is None


def test_money_sums_are_exact(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("double"), F.lit("0.1").cast("decimal(18,2)").alias("dec"))
    row = df.agg(fx.cents_sum("double").alias("d"), fx.cents_sum("dec").alias("e"), fx.average_money("dec").alias("a")).first()
    assert (row.d, row.e, row.a) == (10_000, 10_000, 0.1)


def test_average_ignores_missing_bills(spark):
    df = spark.createDataFrame([(10.0,), (None,), (20.0,)], "x double")
    assert df.agg(fx.average_money("x").alias("a")).first().a == 15.0


def test_sum_past_the_range_raises_instead_of_wrapping(spark):
    df = spark.range(4).select(F.lit(4e16).alias("x"))
    with pytest.raises(Exception, match="(?i)overflow"):
        df.agg(fx.cents_sum("x")).collect()
