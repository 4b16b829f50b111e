"""Near-duplicates by DartMinHash signatures and banded joining.

A text is the multiset of its shingles of five words; the weight of a shingle is its count, and similarity is
weighted Jaccard: shared weight over joint weight. A shingle of weight c owns the region from 0 to c of the
weight axis, cut into unit cells. Darts fall on every cell at exponential intervals of rank, decided by hashes of
the cell and thus the same for all texts that own it. Only darts below a rank that yields about
T (ln T + 3) of them are thrown; of those on a coordinate the earliest is the signature's entry. Two texts
agree on a coordinate with a probability equal to their similarity.

Texts alike in all words are one node. Nodes that agree on a whole band meet in a bucket. Candidate pairs are
compared exactly. In a bucket each node is first compared with one leader, then, only where the bucket still
holds several classes, with another leader. What is left of such buckets is compared in blocks, whole blocks of
nodes at a time in a task, and only links between classes leave it. So a bucket of similar texts costs about its
size, no pairs of a bucket are listed, and every two nodes of a bucket are compared or known to be of one
class. Classes are the connected components of the links.

Defined results: null texts count as empty; a text without words is of a class of its own; a text of fewer than
five words is one shingle; the class id is the smallest doc_id in the class (null only if all are); repeated
rows and equal texts are of one class; the result has one row per input row; an empty table gives an empty
result. Other columns are not read by `near_classes` and pass through `one_of_each_class`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACES, by_bytes, ship, text_of, whole_rows

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 5  # a pair at 0.8 shares no band with a probability of 7e-6
LEADER_ROUNDS = 2
BLOCK = 256  # nodes
_SLAB = 4096  # shingles whose shares are counted at once
_RUN_BYTES = 1_500_000

_U = np.uint64
# Odd multipliers of the hashes; any would do.
_BASE = _U(0x9E3779B97F4A7C15)
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)
_ALL = (1 << 64) - 1
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, _U)
    powers[0] = 1
    return np.cumprod(powers, dtype=_U)


_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _power_tables:
        made = _powers(_BASE, size), _powers(_INVERSE, size)
        if size > 2 * _RUN_BYTES:  # one very long text; not worth keeping
            return made
        _power_tables[size] = made
    return _power_tables[size]


def normal_form(text: str | None) -> bytes:
    """The words with one space between."""
    return b" ".join((text or "").encode("utf-8", "replace").split())


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, sorted within each text, and where each text's begin (and the last end)."""
    words_of = np.array([t.count(b" ") + 1 if t else 0 for t in texts])
    joined = np.frombuffer(b" ".join(t for t in texts if t) + b" ", np.uint8)
    counts = np.where(words_of >= SHINGLE, words_of - SHINGLE + 1, np.minimum(words_of, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not words_of.any():
        return np.empty(0, _U), bounds
    up, down = _tables(len(joined))
    sums = np.concatenate([[_U(0)], np.cumsum((joined.astype(_U) + _U(1)) * up[: len(joined)], dtype=_U)])
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    firsts = np.cumsum(words_of) - words_of
    # Word positions where a shingle begins, and how many words it has.
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = firsts[owner] + np.arange(len(owner)) - bounds[owner]
    width = np.minimum(words_of[owner], SHINGLE)
    total = width.astype(_U)
    padded = np.concatenate([words, np.zeros(SHINGLE, _U)])
    for j in range(SHINGLE):
        part = padded[begin + j] * _PLACES[j]
        total += part if (width > j).all() else np.where(width > j, part, _U(0))
    hashes = _mix(total)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    return hashes, bounds


def _cells(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key for each unit of weight: the shingle and which of its occurrences it is."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    place = np.arange(len(hashes))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mix(hashes + nth.astype(_U) * _BASE)


def signatures(texts: list[bytes], size: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signatures (a row per text, int32); rows of texts without words mean nothing."""
    hashes, bounds = shingle_hashes(texts)
    keys, weight = _cells(hashes, bounds), np.diff(bounds)
    found = np.full((len(texts), size), np.iinfo(np.uint64).max, _U)
    darts = size * (np.log(size) + 3)
    todo = weight > 0
    while todo.any():
        owner = np.repeat(np.arange(len(texts)), np.where(todo, weight, 0))
        key = keys[np.repeat(todo, weight)]
        limit = darts / np.maximum(weight, 1)
        rank, n = np.zeros(len(key)), 0
        while len(key):
            n += 1
            roll = _mix(key + _U(n * int(_PLACES[3]) & _ALL))
            rank = rank - np.log(((roll >> _U(11)).astype(float) + 0.5) * 2.0**-53)
            alive = rank <= limit[owner]
            key, owner, rank, roll = key[alive], owner[alive], rank[alive], roll[alive]
            dart = _mix(roll + _PLACES[4])
            slot = owner * size + (dart % _U(size)).astype(np.int64)
            early = rank.astype(np.float32).view(np.uint32).astype(_U) << _U(32)
            np.minimum.at(found.reshape(-1), slot, early | (dart >> _U(32)))
        todo &= (found == np.iinfo(np.uint64).max).any(1)
        darts *= 2
    return (found & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of shingle hashes."""
    values_a, counts_a = np.unique(a, return_counts=True)
    values_b, counts_b = np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(counts_a[at_a], counts_b[at_b]).sum())
    joint = len(a) + len(b) - shared
    return shared / joint if joint else 0.0


def signed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest of the words, and signature (null without words) of every row."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [normal_form(t) for t in batch.column("text").to_pylist()]
            rows = [signatures(run) for run in by_bytes(forms, len, _RUN_BYTES)]
            found = np.concatenate(rows) if rows else np.empty((0, BANDS * ROWS), np.int32)
            sizes = np.array([len(found[0]) if f else 0 for f in forms], np.int64)
            some = found[sizes > 0].reshape(-1)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.md5(f).digest() for f in forms], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(some)),
                ],
                ["doc_id", "digest", "signature"],
            )

    id_type = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(sign, f"doc_id {id_type}, digest binary, signature array<int>")


def _digest(text: Column) -> Column:
    """The digest of `signed` as a DataFrame function."""
    # Not by a pattern: in Java's, $ also stands before a line terminator that ends the text.
    return F.unhex(F.md5(F.trim(F.regexp_replace(text, SPACES, " "))))


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least that similar."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            for node, text in (("a", "text_a"), ("b", "text_b")):
                own = batch.drop_duplicates(node)
                own = own[~own[node].isin(known)]
                for run in by_bytes(
                    list(zip(own[node], map(normal_form, own[text]), strict=True)), lambda r: len(r[1]), _RUN_BYTES
                ):
                    hashes, bounds = shingle_hashes([form for _, form in run])
                    for (n, _), x, y in zip(run, bounds[:-1], bounds[1:], strict=True):
                        known[n] = hashes[x:y]
            near = [similarity(known[a], known[b]) >= least for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[near, ["a", "b"]]

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").mapInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the smallest node it is connected to.

    Each round takes the smallest label among neighbours, then the label of that label.
    """
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        around = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        nearer = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(
            nearer.join(far, "label", "left").select("node", "old", F.least("label", "far").alias("label"))
        )
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _wordless() -> Column:
    return F.col("signature").isNull() | (F.size("signature") == 0)


def _labelled(
    docs: DataFrame, id_column: str, text_column: str, least: float
) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (digest, keep_id, label) of every node: its smallest id and its class."""
    rows = stage(signed(docs, id_column, text_column))
    nodes = stage(
        rows.where("signature is not null and size(signature) > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.any_value("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * ROWS + 1, ROWS))
    )
    banded = nodes.select("node", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    shared = stage(banded.join(shared, "band"))
    wanted = nodes.select("node", "keep_id", "digest").join(shared.select("node").distinct(), "node", "left_semi")
    read = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    texts = stage(
        read.join(wanted, read["doc_id"].eqNullSafe(wanted["keep_id"]) & (_digest(read["text"]) == wanted["digest"]))
        .select("node", "text")
        .dropDuplicates(["node"])
    )

    labels: DataFrame | None = None
    links: DataFrame | None = None
    seen: DataFrame | None = None
    for round_ in range(LEADER_ROUNDS):
        pairs = _led(_open_buckets(shared, labels), round_)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        seen = stage(pairs)
        found = stage(_compared(seen, texts, least))
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    links = links.unionByName(stage(_across(_open_buckets(shared, labels), texts, least)))
    labels = components(links)
    return rows, nodes.join(labels, "node", "left").select(
        "digest", "keep_id", F.coalesce("label", "node").alias("label")
    )


def near_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """doc_id, class_id, class_size of every row."""
    rows, classed = _labelled(docs, id_column, text_column, least)
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).join(classed, "digest")
    classes = counted.groupBy("label").agg(F.min("keep_id").alias("class_id"), F.sum("_n").alias("class_size"))
    of_digest = classed.select("digest", "label").join(classes, "label").drop("label")
    return rows.join(of_digest, "digest", "left").select(
        "doc_id",
        F.when(_wordless(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(_wordless(), F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
    )


def _open_buckets(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(band, node, label) of the buckets that hold more than one class."""
    if labels is None:
        return shared.withColumn("label", F.col("node"))
    labelled = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return labelled.join(several, "band", "left_semi")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _led(open_: DataFrame, round_: int) -> DataFrame:
    """Each node with its buckets' leaders of another class; another leader in each round."""
    place = F.col("node") if round_ == 0 else F.xxhash64("node", "band", F.lit(round_))
    leaders = open_.groupBy("band").agg(F.min(F.struct(place.alias("p"), "node", "label")).alias("leader"))
    return (
        open_.join(leaders, "band")
        .where("label <> leader.label")
        .select(*_ordered(F.col("node"), F.col("leader.node")))
        .distinct()
    )


def _block_links(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between classes of one bucket, within a block of its nodes or from one block to another."""
    hashes, bounds = shingle_hashes([normal_form(t) for t in frame["text"]])
    cells, weight = _cells(hashes, bounds), np.diff(bounds)
    owner = np.repeat(np.arange(len(frame)), weight)
    values, place, times = np.unique(cells, return_inverse=True, return_counts=True)
    common = times[place] > 1
    rank = np.cumsum(times > 1) - 1  # numbers the cells that several nodes have
    owner, column = owner[common], rank[place[common]]
    shared = np.zeros((len(frame), len(frame)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _SLAB):
        lo, hi = np.searchsorted(column, (start, start + _SLAB))
        slab = np.zeros((len(frame), _SLAB), np.float32)
        slab[owner[lo:hi], column[lo:hi] - start] = 1
        shared += slab @ slab.T
    near = shared >= least * (weight[:, None] + weight[None, :] - shared)
    node, label, block = (frame[c].to_numpy() for c in ("node", "label", "block"))
    near &= label[:, None] < label[None, :]
    if frame["i"].iat[0] != frame["j"].iat[0]:
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    # Nodes may share many bands; one link from a node to a class is enough.
    found = pd.DataFrame({"a": node[a], "b": node[b], "to": label[b]}).drop_duplicates(["a", "to"])
    return pd.DataFrame({"a": found[["a", "b"]].min(axis=1), "b": found[["a", "b"]].max(axis=1)})


def _across(open_: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the classes of a bucket; open_ has (band, node, label).

    A bucket's nodes are dealt into blocks; every two blocks meet in one group, which holds 2 * BLOCK nodes or
    about that. Two nodes were already compared by leaders; only buckets of more come here.
    """
    sizes = open_.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 2")
    blocks = F.ceil(F.col("_n") / BLOCK)
    dealt = (
        open_.join(sizes, "band")
        .withColumn("_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .select("band", "node", "label", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _block_links(frame, least)

    return dealt.join(texts, "node").groupBy("band", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def one_of_each_class(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the text with the smallest id.

    Of rows alike in id and words one stays; different texts stay even if they share an id or have none. Texts in
    classes without any id stay once per class. A row with neither id nor words is a class of its own and stays.
    """
    rows, classed = _labelled(docs, id_column, text_column, SIMILARITY)
    first = F.min(F.struct(F.col("keep_id").isNull().alias("no_id"), "keep_id", "digest")).alias("first")
    chosen = classed.groupBy("label").agg(first).select(F.col("first.keep_id").alias("_nd_id"), F.col("first.digest").alias("_nd_digest"))
    empty = rows.where(_wordless()).select(F.col("doc_id").alias("_nd_id"), F.col("digest").alias("_nd_digest")).distinct()
    # Id and digest as one value that is never null, so that the join and the numbering need one shuffle.
    key = F.struct(F.col("_nd_id").isNull(), F.coalesce(F.col("_nd_id").cast("string"), F.lit("")), "_nd_digest").alias("_nd_key")
    staying = chosen.unionByName(empty).select(key)
    mine = docs.select(
        whole_rows(docs), F.col(id_column).alias("_nd_id"), _digest(text_of(text_column)).alias("_nd_digest")
    )
    alone = F.col("_nd_id").isNull() & (F.col("_nd_digest") == F.unhex(F.md5(F.lit(""))))
    mine = mine.select("row", key, F.when(alone, F.monotonically_increasing_id()).alias("_nd_own"))
    numbered = W.partitionBy("_nd_key", "_nd_own").orderBy(F.xxhash64("row"))
    found = mine.join(staying, "_nd_key").withColumn("_nd_no", F.row_number().over(numbered))
    return found.where("_nd_no = 1").select("row.*")
