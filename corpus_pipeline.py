"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of docs.

1. language ID: documents without a recognised language go. Languages are learned from the documents that name one;
   where none does, nothing is recognised and all documents go.
2. exact dedup: of equal texts (white space aside) the row with the smallest id stays.
3. near dedup: of texts with a similarity of 0.8 or more the row with the smallest id stays.
4. mixing: rows repeat, or drop out, so that each source comes near its target share of words.
5. packing: what is left becomes sequences of at most 2048 tokens; one row per piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from caregauge.llm import exactdedup, language, mixing, neardup, packing
from caregauge.llm.queries import default_tokenizer
from caregauge.session import scratch_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.learn_profiles(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, default_tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Language profiles, signatures and tokens are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def _finished(spark: SparkSession, path: str) -> StructType | None:
    """The schema of a stage's rows if it has ended, as its note beside them says."""
    try:
        return StructType.fromJson(json.loads(spark.read.text(f"{path}.ended").first()["value"]))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages in order over the table of documents.

    folder: keeps what the stages write; a run that names the same one again starts after the last stage that had
    ended. Without it the copies are staged tables, and go with the `staging` block, if any.
    """
    folder = folder or f"{scratch_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        schema = _finished(spark, path)
        if schema is None:
            found = stage(spark, docs, sf_dir)
            found.write.mode("overwrite").parquet(path)
            schema = found.schema
            note = spark.createDataFrame([(schema.json(),)], "value string")
            note.coalesce(1).write.mode("overwrite").text(f"{path}.ended")
        docs = spark.read.schema(schema).parquet(path)
    return docs
