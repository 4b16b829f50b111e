"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import centroids, chat, exactdedup, fingerprint, jaccard, language, mixing, neardup, packing, quality, secrets
from . import substrings, whitening
from .common import fold, ship


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exactdedup.exact_dedup(_read(spark, folder, "documents"), digests=True)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    docs = _read(spark, folder, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    profiles = language.learn_profiles(docs.where(~F.col("held_out")))
    found = language.language_of(F.col("text"), profiles)
    return docs.select("doc_id", "held_out", found.alias("_found")).select(
        "doc_id", "held_out", "_found.lang_pred", "_found.score"
    )


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    docs = _read(spark, folder, "documents")
    labels = _read(spark, folder, "labels").select("doc_id", "quality").where(fold("doc_id", 5) != 0)
    network = quality.train(docs, labels)
    scored = docs.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        quality.quality_of(F.col("text"), network).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def pack_sequences(
    spark: SparkSession, folder: str, tokenizer: str | None = None
) -> DataFrame:
    """tokenizer: path of the tokenizer's file, by default the public byte-level one."""
    ship(spark)
    docs = _read(spark, folder, "documents")
    return packing.pack(packing.token_pieces(docs, tokenizer or default_tokenizer()))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"  # control strings as texts
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(said).alias("text")
    )
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = chat.format_chats(turns.unionByName(odd)).select(
        "conv_id",
        "valid",
        chat.formatted(F.col("segments")).alias("formatted"),
        chat.loss_text(F.col("segments")).alias("learned"),
    )
    back = found.withColumn("turns", chat.read_turns(F.col("formatted")))
    written = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    found = neardup.near_classes(_read(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return substrings.cut_texts(_read(spark, folder, "documents")).drop("kept")


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fingerprint.versions(_read(spark, folder, "documents")).select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.word_hashes(F.col("text")).alias("words"),
        fingerprint.word_hashes(F.col("edited")).alias("edited_words"),
        "every",
        "next_every",
        "next_cut",
        "copies",
    )
    cut = pairs.withColumn("edited_every", fingerprint.coarseness(F.size("edited_words"))).withColumns(
        {
            "own_cut": fingerprint.paragraphs(F.col("words"), F.col("every")),
            "edited_cut": fingerprint.paragraphs(F.col("edited_words"), F.col("edited_every")),
        }
    )

    def at_least(words: str, own: str, every: str, other: str) -> Column:
        """Paragraphs at the coarser of two levels, as texts are compared at one; mostly they are there already."""
        return F.when(F.col(other) <= F.col(every), F.col(own)).otherwise(
            fingerprint.paragraphs(F.col(words), F.col(other))
        )

    pieces = cut.select(
        "*",
        at_least("words", "own_cut", "every", "edited_every").alias("own_for_edited"),
        at_least("edited_words", "edited_cut", "edited_every", "every").alias("edited_for_own"),
        at_least("words", "own_cut", "every", "next_every").alias("own_for_next"),
    )
    found = pieces.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.written(F.col("own_cut"), F.col("every")).alias("fingerprint"),
        fingerprint.written(F.col("edited_cut"), F.col("edited_every")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("own_for_edited"), F.col("edited_for_own")).alias("near_edited"),
        fingerprint.likeness(F.col("own_for_next"), F.col("next_cut")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return found.drop("copy")


def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.clustered(centroids.integer_vectors(_read(spark, folder, "embeddings")))
    written = [",".join(map(str, c)) for c in found.centroids]
    digests = [(j, hashlib.sha256(c.encode()).hexdigest()) for j, c in enumerate(written)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # A row per centroid, hence the broadcasts and the window.
    totals = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = totals.withColumn("inertia", F.sum("cluster_inertia").over(W.partitionBy()))
    return (
        found.rows.join(F.broadcast(totals), "cluster")
        .join(F.broadcast(named), "cluster")
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )


def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(_read(spark, folder, "documents"))


def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_read(spark, folder, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mix_sources,
        "op2_secret_scan": secret_scan,
        "op3_quality_classifier": quality_classifier,
        "op4_near_dedup": near_dedup,
        "op5_exact_dedup": exact_dedup,
        "op6_pack_sequences": pack_sequences,
        "op7_chat_format": chat_format,
        "op8_substring_dedup": substring_dedup,
        "op9_document_fingerprints": document_fingerprints,
        "op10_language_id": language_id,
        "op11_centroid_clusters": centroid_clusters,
        "op12_ngram_jaccard_join": ngram_jaccard_join,
        "op13_embedding_whitening": embedding_whitening,
    }
