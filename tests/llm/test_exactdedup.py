import hashlib
import re
from collections import Counter, defaultdict

from caregauge.llm import exactdedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_equal_brute_force(docs, rows):
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[norm(t)].append(i)
    found = exactdedup.exact_dedup(docs, digests=True).collect()
    assert len(found) == len(rows)
    expected, got = Counter(), Counter()
    for i, t, _ in rows:
        known = [x for x in ids[norm(t)] if x is not None]
        sha = hashlib.sha256(norm(t).encode()).hexdigest()
        expected[(i, min(known) if known else None, len(ids[norm(t)]), sha)] += 1
    for r in found:
        got[(r.doc_id, r.keep_id, r.group_size, r.text_sha256)] += 1
    assert got == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(ids)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_rows_that_stay(docs, rows):
    out = exactdedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t, _ in rows})


def test_prefix_and_length_alike_but_not_the_rest(spark):
    a, b = "p" * 100 + "a", "p" * 100 + "b"
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_dedup(df).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}
    assert sorted(r.doc_id for r in exactdedup.deduplicated(df).collect()) == [1, 2]


def test_nothing_and_nulls(nothing, nulls):
    assert exactdedup.exact_dedup(nothing).count() == 0 and exactdedup.deduplicated(nothing).count() == 0
    found = exactdedup.exact_dedup(nulls).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in found) == [(None, 3, False), (None, 3, False), (None, 3, True)]
    assert exactdedup.deduplicated(nulls).count() == 1
