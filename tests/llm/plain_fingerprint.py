"""Plain version of the rule by which texts are cut into paragraphs, and of their likeness."""

import struct

import xxhash


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def word_hash(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest())


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def words(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def level(n):
    """A word in so many ends a paragraph."""
    every = 1
    while n > every * 24 and every < 32:
        every *= 2
    return every


def cut(text, every):
    """Plain version: a run ends at a cutting word, at 4 * every words, or at the end."""
    found, run = set(), []
    hashes = [word_hash(w) for w in words(text)]
    for i, h in enumerate(hashes, 1):
        run.append(h)
        if h % every == 0 or len(run) == 4 * every or i == len(hashes):
            found.add(chained(run))
            run = []
    return found


def alike(a, b):
    every = max(level(len(words(a))), level(len(words(b))))
    x, y = cut(a, every), cut(b, every)
    return len(x & y) / len(x | y) if x | y else 1.0
