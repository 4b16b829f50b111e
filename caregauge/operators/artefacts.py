"""Fitted models kept as files, so that one fit serves many reports.

A model is keyed by a digest of its input rows and settings. It is fitted and written on first use and read from
its files afterwards, within the session and its staging block; beyond those, save it to a path of your own. Its
settings stand beside it as one line of JSON.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder

Model = TypeVar("Model")

# Folders written by this process, with the application that wrote them.
_written: set[tuple[str, str]] = set()


def input_key(df: DataFrame, settings: Mapping[str, Any]) -> str:
    """A digest of the rows in any order, the columns, and the settings. One aggregate over two row hashes."""
    hashes = [F.xxhash64(*df.columns), F.xxhash64(*df.columns, F.lit(1))]
    sums = [f(h) for h in hashes for f in (F.bit_xor, lambda c: F.sum(c.cast("decimal(20,0)")))]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    text = json.dumps([df.schema.simpleString(), *map(str, found), settings], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def write_settings(spark: SparkSession, settings: Mapping[str, Any], path: str) -> None:
    line = json.dumps(settings, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()["value"])


def kept(
    df: DataFrame,
    name: str,
    settings: Mapping[str, Any],
    fit: Callable[[], Model],
    save: Callable[[Model, str], None],
    load: Callable[[str], Model],
    folder: str | None = None,
) -> Model:
    """The model of these rows and settings: read if it is there (or in the folder given), else fitted and written."""
    spark = df.sparkSession
    path = f"{folder or scratch_folder(spark)}/models/{name}-{input_key(df, settings)}"
    entry = (spark.sparkContext.applicationId, path)
    if entry in _written:
        return load(f"{path}/model")
    model = fit()
    save(model, f"{path}/model")
    write_settings(spark, settings, f"{path}/settings")
    _written.add(entry)
    return model
