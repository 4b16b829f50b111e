"""Near copies stay alike: paragraphs are of bounded size, and their cuts do not depend on what comes before."""

import random

import pytest
from pyspark.sql import functions as F

from caregauge.llm import fingerprint
from caregauge.llm.queries import document_fingerprints

from .plain_fingerprint import alike, word_hash


def pairs_of(spark, pairs):
    """Likeness, number of paragraphs and how many of the first are not in the second, for each pair of texts."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    hashed = df.select("i", *(fingerprint.word_hashes(F.col(c)).alias(c) for c in ("a", "b")))
    every = F.greatest(*(fingerprint.coarseness(F.size(c)) for c in ("a", "b")))
    cut = hashed.select("i", *(fingerprint.paragraphs(F.col(c), every).alias(c) for c in ("a", "b")))
    found = cut.select(
        "i", fingerprint.likeness(F.col("a"), F.col("b")).alias("alike"), F.size("a").alias("n"),
        F.size(F.array_except("a", "b")).alias("lost"),
    )
    return [(r.alike, r.n, r.lost) for r in found.orderBy("i").collect()]


def some_words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def test_long_texts_with_scattered_edits_stay_alike(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(6):
        base = some_words(rng, rng.choice([3_000, 8_000, 20_000]))
        edited = [w if rng.random() >= 0.01 else f"e{rng.randint(0, 10**6)}" for w in base]
        pairs.append((" ".join(base), " ".join(edited)))
    for (a, _), (alike, n, _) in zip(pairs, pairs_of(spark, pairs), strict=True):
        assert len(a.split()) / 64 <= n <= len(a.split()) / 16
        assert alike > 0.4


@pytest.mark.parametrize("differ", [0, 10, 40, 150, 1000])
def test_the_estimate_starts_the_tables(spark, differ):
    rng = random.Random(differ)
    values = [rng.getrandbits(63) for _ in range(600 + differ)]
    df = spark.createDataFrame([(values[:600], values[:600] + values[600:])], "a array<long>, b array<long>")
    row = df.select(
        fingerprint.estimated_difference(F.col("a"), F.col("b")).alias("about"),
        fingerprint.difference_size(F.col("a"), F.col("b")).alias("n"),
    ).first()
    assert row.n == differ and differ <= row.about <= 2 * differ + 20


def test_query_follows_the_rule(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = document_fingerprints(spark, str(tmp_path)).collect()
    known = sorted({(i, t or "") for i, t, _ in rows if i is not None}, reverse=True)
    by_id = {r.doc_id: r for r in found}
    for (i, t), (_, after) in zip(known, known[1:], strict=False):
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert by_id[i].near_edited == pytest.approx(alike(t, edited))
        assert by_id[i].near_next == pytest.approx(alike(t, after))


def test_one_inserted_word_changes_a_paragraph_or_two(spark):
    rng = random.Random(6)
    pairs = []
    for n in (100, 250, 500, 2_000, 9_000):
        base = some_words(rng, n)
        for at in (0, 3, n // 2):
            pairs.append((" ".join(base), " ".join([*base[:at], "w", *base[at:]])))
            pairs.append((" ".join(base), " ".join(base[:at] + base[at + 1 :])))
    for _, n, lost in pairs_of(spark, pairs):
        assert n > 5 and lost <= 2


def test_words_that_never_cut(spark):
    few = next(w for w in "abcdefgh" if word_hash(w) % 32)
    [(same, n, _)] = pairs_of(spark, [(f"{few} " * 5_000, f"{few} " * 4_992)])
    assert (same, n) == (pytest.approx(1 / 2), 2)  # all have the run of 128 words, one also its last 8
