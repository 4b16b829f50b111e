"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is expected target / size times. The
expected copies are summed along a fixed order of the source's documents, one random offset per source is
added, and a document is emitted once for each whole number that its stretch of the sum crosses. Documents
stand in order of size, so that each stretch of similar sizes gives its share and the words taken come near
the target.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; documents
of size 0 count as documents of their source; repeated rows are separate documents; a source without words
takes nothing; an empty table gives an empty result. Columns besides id, text and source pass through
`mixed_documents` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..session import stage
from .common import WORD, text_of, whole_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
# Offsets are multiples of 2**-20, so that whole copies stay exact in floating point.
_OFFSET_DIGITS = 5


def words_in(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Targets for a frame of one row per source (source, docs, source_size).

    Weights repeat over the sources in code point order. `share` times all words are dealt out by weight;
    a source that would get more than `cap` times its words gets just that, and the excess goes to the
    others by weight until none is above. In order of size per weight the capped sources come first, so the
    level that settles it is found from running sums. One row per source is all that this orders.
    """
    in_order = W.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("_rank", F.row_number().over(in_order) - 1).withColumn(
        "_weight",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")),
    )
    by_level = W.orderBy(F.col("source_size") / F.col("_weight"), "_rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_capped_words", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_open_weight", F.sum("_weight").over(onward))
        .withColumn(
            "_level",
            (F.col("_total") * share - F.col("_capped_words") * cap) / F.col("_open_weight"),
        )
        .withColumn("_open", F.col("source_size") * cap > F.col("_level") * F.col("_weight"))
    )
    settled = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    first = F.coalesce(
        F.sum("docs").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return levels.withColumn("_settled", settled).select(
        "source",
        "source_size",
        F.when(F.col("_open"), F.col("_settled") * F.col("_weight"))
        .otherwise(F.col("source_size") * cap)
        .alias("target"),
        first.alias("_first"),
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset, from 0 to below 1."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0")))), 1, _OFFSET_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16**_OFFSET_DIGITS)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            words_in(text_column).alias("size"),
        )
    )
    sources = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")
    )
    targets = source_targets(sources, weights, share, cap).withColumnRenamed("source", "_source")
    placed = global_position(sized, [F.asc_nulls_last("source"), F.desc("size"), F.asc_nulls_last("doc_id")])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_row") - F.col("_first")
    crossed = F.floor((place + 1) * rate + F.col("_offset")) - F.floor(place * rate + F.col("_offset"))
    return (
        placed.join(targets, placed["source"].eqNullSafe(targets["_source"]))
        .withColumn("_offset", offset(F.col("source"), seed))
        .withColumn("copies", F.least(crossed, F.ceil(rate)).cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as the mix takes it.

    Rows meet their counts by id, source and size; rows alike in all three are numbered on both sides.
    """
    names = {
        "doc_id": options.get("id_column", "doc_id"),
        "source": options.get("source_column", "source"),
    }
    keys = {
        "_mix_id": F.col(names["doc_id"]),
        "_mix_source": F.col(names["source"]).cast("string"),
        "_mix_size": words_in(options.get("text_column", "text")),
    }
    alike = W.partitionBy(*keys)
    taken = (
        mix(docs, **options)
        .select(
            F.col("doc_id").alias("_mix_id"),
            F.col("source").alias("_mix_source"),
            F.col("size").alias("_mix_size"),
            "copies",
        )
        .withColumn("_mix_no", F.row_number().over(alike.orderBy("copies")))
        .select(*(F.col(c).alias(f"{c}_of") for c in [*keys, "_mix_no"]), F.col("copies").alias("_mix_copies"))
    )
    given = docs.select(whole_rows(docs), *(value.alias(name) for name, value in keys.items()))
    keyed = given.withColumn("_mix_no", F.row_number().over(alike.orderBy(F.xxhash64("row"))))
    together = keyed.join(
        taken.where(F.col("_mix_copies") > 0),
        (keyed["_mix_id"].eqNullSafe(taken["_mix_id_of"]))
        & (keyed["_mix_source"].eqNullSafe(taken["_mix_source_of"]))
        & (keyed["_mix_size"] == taken["_mix_size_of"])
        & (keyed["_mix_no"] == taken["_mix_no_of"]),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))
    return together.select("row", copies.alias("_mix_copy")).select("row.*")
