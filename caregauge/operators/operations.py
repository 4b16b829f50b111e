"""Procedure, sales and schedule dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import average_money, cents_sum, cents_to_double, pct, ratio, rounded, rows


def procedure_kpis(procedures: DataFrame) -> DataFrame:
    """Totals over procedures alone. Joining admissions first would repeat costs."""
    return procedures.agg(
        rows().alias("total_procedures"),
        rounded(average_money("cost"), 2).alias("avg_cost"),
        cents_to_double(cents_sum("cost")).alias("total_cost"),
    )


def department_procedure_volume(procedures: DataFrame) -> DataFrame:
    volumes = procedures.groupBy("department_name").agg(rows().alias("procedures"))
    rank = F.rank().over(W.orderBy(F.desc("procedures"))).cast("long")
    return volumes.withColumn("volume_rank", rank).orderBy("volume_rank", "department_name")


def procedures_per_admission(procedures: DataFrame) -> DataFrame:
    """How many admissions have one procedure, two, and so on."""
    return (
        procedures.groupBy("admission_id")
        .agg(rows().alias("procedures"))
        .groupBy("procedures")
        .agg(rows().alias("admissions"))
        .orderBy("procedures")
    )


def volume_revenue_correlation(procedures: DataFrame) -> DataFrame:
    """Pearson correlation of procedure count and revenue over departments."""
    departments = procedures.groupBy("department_name").agg(
        rows().alias("procedures"), cents_to_double(cents_sum("cost")).alias("revenue")
    )
    return departments.agg(
        rows().alias("departments"), F.corr("procedures", "revenue").alias("correlation")
    )


def sales_kpis(sales: DataFrame) -> DataFrame:
    return sales.agg(
        cents_to_double(cents_sum("amount")).alias("total_sales"),
        rows().alias("transactions"),
        rounded(average_money("amount"), 2).alias("avg_sale"),
        F.max("amount").cast("double").alias("max_sale"),
    )


def sales_share_by_region(sales: DataFrame) -> DataFrame:
    regions = sales.groupBy("region").agg(cents_sum("amount").alias("total"))
    return regions.select(
        "region",
        cents_to_double("total").alias("total_sales"),
        rounded(pct("total", F.sum("total").over(W.partitionBy())), 2).alias("share_pct"),
    ).orderBy(F.desc("total_sales"), "region")


def schedule_kpis(schedule: DataFrame) -> DataFrame:
    return schedule.agg(
        F.count_distinct("train").alias("trains"),
        F.count_distinct("station").alias("stations"),
        rows().alias("schedules"),
    )


def station_frequency(schedule: DataFrame) -> DataFrame:
    """Schedules and distinct trains per station, with the station's share of all schedules."""
    stations = schedule.groupBy("station").agg(
        rows().alias("schedules"), F.count_distinct("train").alias("trains")
    )
    return stations.select(
        "*",
        rounded(pct("schedules", F.sum("schedules").over(W.partitionBy())), 2).alias("share_pct"),
    ).orderBy(F.desc("schedules"), "station")


def utilisation_ratio(usage: DataFrame, current: str, capacity: str) -> DataFrame:
    """Add utilisation = current / capacity; null where the capacity is zero or unknown."""
    return usage.withColumn("utilisation", rounded(ratio(current, capacity), 4))


def daily_schedule_usage(schedule: DataFrame) -> DataFrame:
    """Per station: schedules on its last day, against those on its busiest day as the capacity."""
    days = schedule.groupBy("station", "day").agg(rows().alias("schedules"))
    usage = days.groupBy("station").agg(
        F.max_by("schedules", "day").alias("current_schedules"),
        F.max("schedules").alias("max_schedules"),
    )
    return utilisation_ratio(usage, "current_schedules", "max_schedules").orderBy("station")
