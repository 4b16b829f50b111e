import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caregauge.llm import fingerprint
from caregauge.llm.queries import document_fingerprints

from .plain_fingerprint import alike, cut, signed


def test_query_equals_plain_version(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = document_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    distinct = {(i, t or "") for i, t, _ in rows}
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    known = sorted((x for x in distinct if x[0] is not None), reverse=True)
    for (i, t), (_, after) in zip(known, known[1:], strict=False):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        for r in by_id[i]:
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(alike(t, edited)) and r.near_next == pytest.approx(alike(t, after))
    prints = {}
    for r in found:
        if r.doc_id is not None:
            prints.setdefault(dict(known)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())


@pytest.mark.parametrize("differ", [0, 3, 12, 60, 300])
def test_peeling_recovers_the_difference(spark, differ):
    rng = random.Random(differ)
    values = [signed(rng.getrandbits(64)) for _ in range(400 + differ)]
    a, b = values[: 400 + differ // 2], values[:400] + values[400 + differ // 2 :]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    both = F.col("a"), F.col("b")
    row = df.select(
        fingerprint.difference_size(*both).alias("n"),
        fingerprint.difference(*both).alias("digests"),
        fingerprint.likeness(*both).alias("alike"),
        fingerprint.peel(fingerprint.subtract(fingerprint.sketch(both[0], 96), fingerprint.sketch(both[1], 96)), 96).alias("at_96"),
    ).first()
    assert row.n == differ and row.alike == pytest.approx(400 / (400 + differ))
    # 1 stands for the first set, -1 for the second.
    apart = sorted([(1, v) for v in set(a) - set(b)] + [(-1, v) for v in set(b) - set(a)])
    assert sorted(map(tuple, row.digests)) == apart
    if differ <= 12:
        assert sorted(map(tuple, row.at_96)) == apart
    elif differ >= 300:
        assert row.at_96 is None


def test_nothing_and_one(spark, nothing, nulls, tmp_path):
    nothing.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert document_fingerprints(spark, f"{tmp_path}/none").count() == 0
    nulls.write.parquet(f"{tmp_path}/nulls/documents.parquet")
    found = document_fingerprints(spark, f"{tmp_path}/nulls").collect()
    assert [(r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in found] == [(None, 0, 1.0, 1.0)] * 3
    spark.createDataFrame([(5, "one two three")], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    row = document_fingerprints(spark, f"{tmp_path}/one").first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"one two tone ").hexdigest()


def test_paragraphs_of_an_unnamed_argument(spark):
    """Words are hashed once, however often the rule looks at them."""
    texts = [" ".join(f"w{i * j}" for i in range(600)) for j in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", fingerprint.paragraphs(fingerprint.word_hashes(F.col("text")), F.lit(32).cast("long")).alias("p"))
    assert all(set(r.p) == cut(r.text, 32) for r in found.collect())
