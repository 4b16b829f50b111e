"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after each run of white space is replaced by one space. Only rows
whose length, and then whose length and prefix hash, occur more than once go on; the full hash is taken of
those alone.

Defined results: a null text counts as empty; of equal texts the row with the smallest id stays, a null id
only if there is no other; of repeated rows with the same id and text exactly one is kept; the result has one
row per input row; an empty table gives an empty result. Other columns are not read by `exact_dedup` and pass
through `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACES, same, text_of, whole_rows

PREFIX = 64
BUCKETS = 1 << 18
KEYS = ["doc_id", "_len", "_prefix"]


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACES, " ")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, length and prefix hash of every row, and the normalised text for those who still need it."""
    return docs.select(
        F.col(id_column).alias("doc_id"), normalised(text_column).alias("_norm")
    ).select(
        "doc_id",
        F.length("_norm").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_prefix"),
        "_norm",
    )


def _groups(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, alone): rows by KEYS with their count _n, those with equals elsewhere and the others."""
    # Rows alike in id, length and prefix are counted once; the counts come back at the end.
    narrow = stage(keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")))

    def repeated(frame: DataFrame, keys: list[str]) -> DataFrame:
        counts = frame.groupBy(*keys).agg(F.sum("_n").alias("_rows")).where("_rows > 1").drop("_rows")
        return frame.join(counts, keys, "left_semi")

    survivors = stage(repeated(repeated(narrow, ["_len"]), ["_len", "_prefix"]).select(*KEYS))
    # Texts are hashed where they are read, and only hashes are shuffled. A row takes part if its key falls
    # in a bucket that some survivor is in: at most BUCKETS rows to broadcast. The join by key is exact, and
    # meets rows by id, so that a large group stays spread out.
    bucket = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(BUCKETS)).alias("_bucket")
    in_use = survivors.select(bucket).distinct()
    hashed = (
        keyed.select(*KEYS, "_norm", bucket)
        .join(F.broadcast(in_use), "_bucket", "left_semi")
        .select(*KEYS, F.sha2("_norm", 256).alias("text_sha256"))
        .groupBy(*KEYS, "text_sha256")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    full = stage(hashed.join(survivors, same(hashed, survivors, KEYS), "left_semi"))
    group = ["_len", "_prefix", "text_sha256"]
    keepers = full.groupBy(*group).agg(
        F.min("doc_id").alias("keep_id"), F.sum("_n").alias("group_size")
    )
    grouped = full.join(keepers, group).select(*KEYS, "text_sha256", "_n", "keep_id", "group_size")
    alone = narrow.join(survivors, same(narrow, survivors, KEYS), "left_anti").select(*KEYS, "_n")
    return grouped, alone


def _with_own_id(alone: DataFrame) -> DataFrame:
    return alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digests: bool = False
) -> DataFrame:
    """doc_id, keep_id, group_size, kept for every row of docs; with digests also text_sha256.

    digests: hash also the texts that needed no full hash, for callers who want it of every row.
    """
    keyed = _keyed(docs, id_column, text_column)
    grouped, alone = _groups(keyed)
    if digests:
        every = keyed.select(
            *(F.col(c).alias(f"_of_{c}") for c in KEYS), F.sha2("_norm", 256).alias("text_sha256")
        )
        match = (
            alone["doc_id"].eqNullSafe(every["_of_doc_id"])
            & (alone["_len"] == every["_of__len"])
            & (alone["_prefix"] == every["_of__prefix"])
        )
        alone = alone.join(every, match)
    else:
        alone = alone.withColumn("text_sha256", F.lit(None).cast("string"))
    columns = ["doc_id", "keep_id", "group_size", "_n", "text_sha256"]
    rows = grouped.select(*columns).unionByName(_with_own_id(alone).select(*columns))
    numbered = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return numbered.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), *(["text_sha256"] if digests else [])
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    grouped, alone = _groups(_keyed(docs, id_column, text_column))
    staying = (
        grouped.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(*KEYS, "text_sha256")
        .unionByName(alone.select(*KEYS, F.lit(None).cast("string").alias("text_sha256")))
        .select(*(F.col(c).alias(f"_dd{c}") for c in [*KEYS, "text_sha256"]))
    )
    given = docs.select(whole_rows(docs), F.col(id_column).alias("_dd_id"), normalised(text_column).alias("_dd_norm"))
    mine = given.withColumns(
        {"_dd_my_len": F.length("_dd_norm"), "_dd_my_prefix": F.xxhash64(F.substring("_dd_norm", 1, PREFIX))}
    )
    match = (
        F.col("_dd_id").eqNullSafe(F.col("_dddoc_id"))
        & (F.col("_dd_my_len") == F.col("_dd_len"))
        & (F.col("_dd_my_prefix") == F.col("_dd_prefix"))
        & (F.col("_ddtext_sha256").isNull() | (F.sha2("_dd_norm", 256) == F.col("_ddtext_sha256")))
    )
    # Rows of one id and text: the first by a hash of all columns stays.
    repeats = W.partitionBy("_dddoc_id", "_dd_len", "_dd_prefix", "_ddtext_sha256").orderBy(F.xxhash64("row"))
    return (
        mine.join(staying, match)
        .withColumn("_dd_no", F.row_number().over(repeats))
        .where("_dd_no = 1")
        .select("row.*")
    )
