import re
from collections import Counter, defaultdict

import pytest

from caregauge.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    """The contract's own procedure: share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(target[s] - 2 * sizes[s], 0) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_words_taken(docs, rows):
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter(
        (i, s, len(WORD.findall(t or ""))) for i, t, s in rows
    )
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    expected = expected_targets(sizes)
    for r in found:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]
    for s, words in taken.items():
        assert abs(words - expected[s]) <= largest[s]
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_documents_repeat_as_often_as_they_are_taken(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.source, r["size"])] += r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert out == Counter({k: n for k, n in copies.items() if n})


def test_nothing_and_nulls(nothing, nulls):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(nulls).collect()] == [(0, 0.0, 0)] * 3
