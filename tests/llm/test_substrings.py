import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from caregauge.llm import substrings


def expected(rows, window=substrings.WINDOW):
    """Brute force over sets of windows; rows without an id come last and cover nothing."""
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - window + 1):
            if i is not None:
                first[data[k : k + window]] = min(first.get(data[k : k + window], i), i)
    out = Counter()
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - window + 1):
            smallest = first.get(data[k : k + window])
            if smallest is not None and (i is None or smallest < i):
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)] += 1
    return out


def check(frame, rows, **options):
    got = Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
        for r in substrings.cut_texts(frame, **options).collect()
    )
    assert got == expected(rows)


def test_equals_brute_force(docs, rows):
    check(docs, [(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("seed", range(3))
def test_passages_edges_and_periodic_texts(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 2 else "abcdé fgh"
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([48, 49, 50, 51, 52, 75, 130]))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(20)) for _ in range(6)]
        rows.append((rng.randint(0, 50), "".join(parts)[rng.randint(0, 30) :]))
    rows += [(60, "ab" * 100), (61, "ba" * 60), (62, "a" * 300), (63, "a" * 50), (64, "a" * 49), (65, "xyz" * 40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows, buckets=5)


def test_hot_passage_and_small_batches(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows = [(i, f"{rng.random()} {passage[rng.randint(0, 9):]} {rng.random()}" if i % 3 else f"{rng.random()}") for i in range(200)]
    monkeypatch.setattr(substrings, "_BATCH_BYTES", 900)
    monkeypatch.setattr(substrings, "_RUN_BYTES", 300)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize(("crowd", "crowded"), [(2, 1 << 16), (5, 1 << 16), (64, 2), (2, 2)])
def test_crowded_grams(spark, monkeypatch, crowd, crowded):
    rng = random.Random(crowd)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows = [(i, f"{rng.choice('xyz')}{passage[rng.randint(0, 3):]}{rng.choice('uvw')} {rng.random()}") for i in range(150)]
    rows += [(None, f"x{passage}u {rng.random()}"), (None, f"{rng.random()} x{passage}"), (7, passage), (400, f"{passage[:60]}?")]
    rng.shuffle(rows)
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "_BATCH_BYTES", 2500)
    monkeypatch.setattr(substrings, "_CROWD_RECORDS", 30)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_windows_of_a_crowd_spread_over_the_buckets():
    """A thousand documents with one passage: the bucket of its edges gets a mark, and no bucket many of the windows."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    texts = [f"{rng.random()}{passage}{rng.random()}" for _ in range(1000)]
    batch = pd.DataFrame({"doc_id": range(1000), "mark": 0, "text": texts})
    packed = pd.concat(substrings._records(64)([batch]))
    kept, opened = Counter(), []
    for bucket, data in zip(packed["bucket"], packed["records"], strict=True):
        kept[bucket] += len(substrings._unpack(data)[0])
        if bucket < 0 and bucket % 2 == 0:
            opened.append(substrings._first_pass(pd.DataFrame({"bucket": [bucket], "records": [data]})))
    rows = pd.concat(opened).groupby(["doc_id", "mark"], as_index=False).agg(list)
    assert len(rows) > 900 and max(kept.values()) < 400
    rows["packed"] = [zlib.compress(texts[i].encode()) for i in rows["doc_id"]]
    segments = pd.concat(substrings._segments(64)([rows]))
    sent = Counter()
    for bucket, data in zip(segments["bucket"], segments["segments"], strict=True):
        sent[bucket] += len(data) // (40 + substrings._LONGEST) if bucket >= 0 else 0
    assert max(sent.values()) < 3 * sum(sent.values()) / 64


def test_radix_passes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (400, 4)).astype(np.uint64)
    ids, group = rng.integers(0, 9, 400), rng.integers(0, 3, 400)
    found, least = substrings.radix_groups(group, lambda i, at: rows[at, i], ids, 4)
    seen = {}
    for g, r, i in zip(group, map(tuple, rows), ids, strict=True):
        seen.setdefault((g, r), set()).add(i)
    wanted = {n: min(seen[(group[n], tuple(rows[n]))]) for n in range(400) if len(seen[(group[n], tuple(rows[n]))]) > 1}
    assert dict(zip(found, least, strict=True)) == wanted


def test_nothing_and_nulls(nothing, nulls):
    assert substrings.cut_texts(nothing).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    found = substrings.cut_texts(nulls).collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == [(None, 0, 0, 0, empty)] * 3
