"""The data dictionary, read from the table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.schemas import TABLES


def data_dictionary(spark: SparkSession) -> DataFrame:
    """One row per documented column."""
    documented = [
        (table, field.name, field.dataType.simpleString(), field.metadata["comment"])
        for table, schema in TABLES.items()
        for field in schema.fields
        if "comment" in field.metadata
    ]
    columns = "table_name string, column_name string, data_type string, description string"
    return spark.createDataFrame(documented, columns)
