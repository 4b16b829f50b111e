import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from caregauge.llm import neardup


def cells(text):
    w = (text or "").encode().split()
    counts = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else {}
    return {(g, n) for g, c in counts.items() for n in range(c)}


def classes(rows, least=0.8):
    """Brute force: compare all pairs, join the near ones; row number -> rows of its class."""
    sets = [cells(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    return {i: m for m in members.values() for i in m}


def check(frame, rows):
    expected = Counter()
    for i, members in classes(rows).items():
        known = [rows[m][0] for m in members if rows[m][0] is not None]
        own = rows[i][0]
        expected[(own, (min(known) if known else None) if cells(rows[i][1]) else own, len(members))] += 1
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_classes(frame).collect())
    assert got == expected


def test_classes_equal_brute_force(docs, rows):
    check(docs, [(i, t) for i, t, _ in rows])
    out = neardup.one_of_each_class(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert max(n for i, n in ids.items() if i is not None) == 1
    kept = {r.class_id for r in neardup.near_classes(docs).collect()}
    assert set(ids) == kept


@pytest.mark.parametrize("edits", [2, 6])
def test_a_large_group_of_near_copies(spark, edits):
    """Most share buckets; with 6 edits many pairs are just below or above the limit."""
    rng = random.Random(edits)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_compare_across_each_other(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "_SLAB", 7)
    texts = ["a b c d e f g", "a b c d e f h", "q r s t u v w", "q r s t u v x", "a b c d e f g", "1 2 3 4 5 6 7"]
    frame = [(0, i, i) for i in range(len(texts))]
    open_ = spark.createDataFrame(frame, "band long, node long, label long")
    stored = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {tuple(r) for r in neardup._across(open_, stored, 0.4).collect()}
    sets = [cells(t) for t in texts]
    near = {
        (i, j) for j in range(6) for i in range(j) if len(sets[i] & sets[j]) >= 0.4 * len(sets[i] | sets[j])
    }
    assert found == near


def test_agreement_of_signatures_is_the_weighted_similarity():
    rng = random.Random(4)
    for share in (0.2, 0.5, 0.9):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
        other = [w if rng.random() < share**0.2 else w + "x" for w in base]
        pair = [neardup.normal_form(" ".join(x * 2)) for x in (base, other)]
        a, b = neardup.signatures(pair, size=3000)
        x, y = cells(pair[0].decode()), cells(pair[1].decode())
        true = len(x & y) / len(x | y)
        assert np.mean(a == b) == pytest.approx(true, abs=0.04)
        hashes, bounds = neardup.shingle_hashes(pair)
        assert neardup.similarity(hashes[: bounds[1]], hashes[bounds[1] :]) == pytest.approx(true)


def test_signatures_do_not_depend_on_the_batch():
    texts = [neardup.normal_form(t) for t in ("a b c d e f g h", "x", "", "a a a a a a a a a a", "p q r s t u " * 50)]
    together = neardup.signatures(texts)
    for i, t in enumerate(texts):
        if t:
            assert (neardup.signatures([t])[0] == together[i]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (102, 107)]
    links = spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long")
    found = {r.node: r.label for r in neardup.components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102, 107), 100)}


def test_nothing_and_nulls(nothing, nulls):
    assert neardup.near_classes(nothing).count() == 0 and neardup.one_of_each_class(nothing).count() == 0
    assert [(r.class_id, r.class_size) for r in neardup.near_classes(nulls).collect()] == [(None, 1)] * 3
