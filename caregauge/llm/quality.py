"""Text quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over overlapping chunks that cover the whole text; each filter's largest
response in a chunk is kept, and the mean, least and largest of these over the chunks, with the text's
length, go through a small dense layer to one probability.

The network is fitted on the driver on at most `sample` labelled rows, the ones with the smallest hash of
their id, of at most `sample_bytes` in all; scoring is a map over all rows that holds a bounded slab of chunks at a time.

Defined results: a null text counts as empty, and an empty text is scored like any other; equal texts get
equal scores; labelled rows with a null label are not used; without any labelled row every score is 0.5; an
empty table gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ship

SAMPLE = 3000
SAMPLE_BYTES = 64 << 20
CHUNK = 512
STRIDE = 448
WIDTH = 5
FILTERS = 24
HIDDEN = 16
EPOCHS = 8
_PAD = 256
_SLAB = 64  # chunks whose responses are held at once


def chunks_of(data: bytes) -> np.ndarray:
    """The text's chunks, a row each; the last one ends with the text."""
    n = len(data)
    points = np.full(max(n, CHUNK) + WIDTH - 1, _PAD, np.int16)
    points[:n] = np.frombuffer(data, np.uint8)
    starts = np.arange(0, max(n - CHUNK, 0) + STRIDE, STRIDE)
    starts = np.unique(np.minimum(starts, max(n - CHUNK, 0)))
    return points[starts[:, None] + np.arange(CHUNK + WIDTH - 1)]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.params = {
            "filters": rng.normal(0, 0.3, (WIDTH, _PAD + 1, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, 0.2, (3 * FILTERS + 1, HIDDEN)).astype(np.float32),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.2, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.params["filters"][:, _PAD] = 0

    def responses(self, chunks: np.ndarray, where: bool = False):
        """Each filter's largest response per chunk, and where it is."""
        filters = self.params["filters"]
        best = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int64) if where else None
        for i in range(0, len(chunks), _SLAB):
            slab = chunks[i : i + _SLAB]
            total = filters[0][slab[:, :CHUNK]]
            for k in range(1, WIDTH):
                total += filters[k][slab[:, k : k + CHUNK]]
            if where:
                at[i : i + _SLAB] = total.argmax(1)
            best[i : i + _SLAB] = total.max(1)
        return best + self.params["bias"], at

    def features(self, pooled: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = np.diff([*firsts, len(pooled)])[:, None]
        return np.concatenate(
            [
                np.add.reduceat(pooled, firsts) / counts,
                np.minimum.reduceat(pooled, firsts),
                np.maximum.reduceat(pooled, firsts),
                np.log2(sizes[:, None] + 1) / 10,
            ],
            1,
        ).astype(np.float32)

    def forward(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.params
        hidden = np.tanh(features @ p["dense"] + p["dense_bias"])
        return hidden, 1 / (1 + np.exp(-(hidden @ p["out"] + p["out_bias"][0])))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        pooled, firsts, n = [], [], 0
        for text in texts:
            own = np.maximum(self.responses(chunks_of(text))[0], 0)
            firsts.append(n)
            pooled.append(own)
            n += len(own)
        sizes = np.array([len(t) for t in texts], float)
        features = self.features(np.concatenate(pooled), np.array(firsts), sizes)
        return self.forward(features)[1].astype(float)


def _gradients(net: Network, texts: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> dict:
    p = net.params
    chunks = np.concatenate(texts)
    firsts = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    raw, at = net.responses(chunks, where=True)
    pooled = np.maximum(raw, 0)
    features = net.features(pooled, firsts, sizes)
    hidden, probability = net.forward(features)
    d_out = ((probability - labels) / len(labels)).astype(np.float32)
    d_hidden = d_out[:, None] * p["out"] * (1 - hidden**2)
    d_features = d_hidden @ p["dense"].T
    counts = np.bincount(owner)[:, None]
    mean, least, most = (d_features[:, i * FILTERS : (i + 1) * FILTERS] for i in range(3))
    d_pooled = (mean / counts)[owner]
    for part, i in ((least, 1), (most, 2)):  # ties share
        hit = pooled == features[owner, i * FILTERS : (i + 1) * FILTERS]
        d_pooled += part[owner] * hit / np.add.reduceat(hit, firsts)[owner]
    d_pooled *= raw > 0
    d_filters = np.empty_like(p["filters"])
    rows, cols = np.arange(len(chunks))[:, None], np.arange(FILTERS)
    for k in range(WIDTH):
        index = chunks[rows, at + k].astype(np.int64) * FILTERS + cols
        d_filters[k] = np.bincount(index.ravel(), d_pooled.ravel(), (_PAD + 1) * FILTERS).reshape(
            -1, FILTERS
        )
    d_filters[:, _PAD] = 0
    return {
        "filters": d_filters,
        "bias": d_pooled.sum(0),
        "dense": features.T @ d_hidden,
        "dense_bias": d_hidden.sum(0),
        "out": hidden.T @ d_out,
        "out_bias": d_out.sum(keepdims=True),
    }


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted by Adam to labels 0 and 1."""
    net, rng = Network(seed), np.random.default_rng(seed)
    chunked = [chunks_of(t) for t in texts]
    sizes = np.array([len(t) for t in texts], float)
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 32):
            batch = order[i : i + 32]
            step += 1
            rate = 0.01 if epoch < epochs - 2 else 0.002
            for k, g in _gradients(net, [chunked[j] for j in batch], sizes[batch], labels[batch]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net.params[k] = (net.params[k] - rate * move).astype(np.float32)
    return net


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_column: str = "text",
    label_column: str = "quality",
    id_column: str = "doc_id",
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
) -> Network | None:
    """A network fitted on the texts of `training_rows`; None if there are none."""
    rows = training_rows(docs, labels, text_column, label_column, id_column, sample, sample_bytes)
    return fit([t for t, _ in rows], np.array([y for _, y in rows])) if rows else None


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    text_column: str = "text",
    label_column: str = "quality",
    id_column: str = "doc_id",
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
) -> list[tuple[bytes, float]]:
    """(text, label) of at most `sample` labelled ids, of at most `sample_bytes` together, in a fixed order.

    The ids are chosen from the labels alone, so at most `sample` rows are broadcast, and no text is shuffled. Sizes
    reach the driver before texts do; in the order of a hash, a text that no longer fits is left out.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .select(
            F.xxhash64(F.col(id_column)).alias("place"),
            F.col(id_column).alias("id"),
            F.col(label_column).cast("double").alias("label"),
        )
        .orderBy("place", "id", "label")
        .limit(sample)
    )
    texts = docs.select(
        F.col(id_column).alias("_id"),
        F.encode(F.coalesce(F.col(text_column).cast("string"), F.lit("")), "UTF-8").alias("text"),
    )
    met = stage(texts.join(F.broadcast(chosen), F.col("_id") == F.col("id")).select("place", "id", "label", "text"))
    room, most = sample_bytes, 0
    sizes = met.select("place", "id", "label", F.octet_length("text").alias("size"), F.md5("text").alias("digest")).collect()
    fitting = []
    for row in sorted(sizes, key=tuple):  # the order in which tasks answer must not matter
        if row["size"] <= room:
            room -= row["size"]
            most = max(most, row["size"])
            fitting.append(tuple(row))
    if not fitting:
        return []
    wanted = Counter(fitting)
    rows = []
    for r in met.where(F.octet_length("text") <= most).toLocalIterator():
        text = bytes(r["text"])
        key = (r["place"], r["id"], r["label"], len(text), hashlib.md5(text).hexdigest())
        if wanted[key]:
            wanted[key] -= 1
            rows.append((key[:3], text))
    rows.sort()
    return [(text, key[2]) for key, text in rows]


def quality_of(text: Column, network: Network | None) -> Column:
    """The score of a text column, 0 to 1."""
    if network is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(network.score([(t or "").encode("utf-8", "replace") for t in texts]))

    return score(text)
