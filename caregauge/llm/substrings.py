"""Suffix-array dedup: removal of byte strings that an earlier document holds too.

A window is a string of WINDOW bytes; it is repeated in a document if it also starts in a document with a
smaller id. The windows are ordered by most-significant-digit radix passes that stop at WINDOW bytes: groups
that are still equal then are the repeated windows, and a group with one document is dropped at once.

The first pass is spread over the cluster. Its digit is a gram of GRAM bytes, taken not at the window's start but
at its anchor, the gram of smallest hash within the window (the leftmost of equals), so that equal windows have
equal anchors and the 20 or so windows in a row that share an anchor travel as one record. A record's other
digit is a hash of all bytes that its windows cover. Records alike in both need no further pass: all but the
smallest document's windows are repeated. Where documents share a gram but not the rest, the bytes themselves
are sent for, and windows go through the remaining passes, eight bytes at a time.

Before anything is shuffled, records alike in both digits are thinned within a batch to those of the smallest
document. Records are packed by bucket of the gram, so that the shuffle moves few large rows. The number of buckets
and of tasks follows from the bytes of all texts.

A gram at the edge of a passage that very many documents hold has a record of its own in each of them. Where CROWD
documents of a batch share such a gram, their records do not meet in its bucket: a mark takes their place there, and
their windows are dealt out one by one, by their bytes. So are those that other batches sent to the bucket, and those
of a gram with CROWDED records there. Of equal windows a batch sends on the smallest document's.

Defined results: a null text counts as empty; texts below WINDOW bytes keep all bytes; rows with equal ids
count as one document and each is cut by its own text; a row without an id comes after all others, covers
nothing and is covered by any; the result has one row per input row; an empty table gives an empty result. Ids
are integers. Other columns are not read by `repeated_spans` and pass through `without_repeats`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_bytes, same, ship, text_of
from .neardup import _BASE, _U, _mix, _tables

WINDOW = 50
GRAM = 20
FLAGS = 1 << 18
_GRAMS = WINDOW - GRAM + 1  # in a window
_LONGEST = WINDOW + _GRAMS - 1  # bytes that the windows of one anchor cover
_RUN_BYTES = 1_000_000
_BATCH_BYTES = 8_000_000
_BUCKETS = 2  # for each shuffle partition, at least
_BUCKET_BYTES = 16_000_000  # of text
_TASK_BYTES = 64_000_000  # of text
CROWD = 64
CROWDED = 1 << 16
_CROWD = _U(1 << 63)  # stands for the gram of a record whose windows are dealt out one by one
_CROWD_RECORDS = 20_000  # at once
_LAST = np.iinfo(np.int64).max  # stands for a missing id
_KEYS = ["doc_id", "mark"]


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Records of the texts: text (its place in the list), at (first window), count (of windows), gram, whole."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    empty = {"text": np.empty(0, np.int32), "at": np.empty(0, np.int32), "count": np.empty(0, np.uint8)}
    if n < WINDOW:
        return empty | {"gram": np.empty(0, _U), "whole": np.empty(0, _U)}
    up, down = _tables(n + 1)
    sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * up[:n], dtype=_U)])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # The place of the smallest gram among the next 1, 2, 4, ... and then _GRAMS grams.
    best, reach = np.arange(len(grams), dtype=np.int64), 1
    while reach < _GRAMS:
        step = min(reach, _GRAMS - reach)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        reach += step
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    window = np.arange(len(best))
    window = window[window + WINDOW <= ends[owner[: len(best)]]]
    if not len(window):
        return empty | {"gram": np.empty(0, _U), "whole": np.empty(0, _U)}
    anchor = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    start, count = window[first], np.diff(np.append(first, len(window)))
    stop = start + count - 1 + WINDOW
    inside = ((anchor[first] - start) * 64 + count).astype(_U)
    whole = _mix((sums[stop] - sums[start]) * down[start] + inside * _BASE)
    text = owner[start]
    return {
        "text": text.astype(np.int32),
        "at": (start - (ends - sizes)[text]).astype(np.int32),
        "count": count.astype(np.uint8),
        "gram": grams[anchor[first]],
        "whole": whole,
    }


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_bytes(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<u8").reshape(-1).astype(_U)


def _pack(ids: np.ndarray, marks: np.ndarray, at: np.ndarray, count: np.ndarray, gram: np.ndarray, whole: np.ndarray) -> bytes:
    """Records in order of document and place, as columns; places are differences within a document."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    steps = np.diff(at.astype(np.int64), prepend=0)
    steps[first] = at[first]
    width = np.uint16 if steps.max(initial=0) < 1 << 16 else np.uint32
    head = np.array([len(ids), len(first), np.dtype(width).itemsize], np.int64)
    runs = np.diff(np.append(first, len(ids))).astype(np.uint32)
    return b"".join(
        [
            head.tobytes(), ids[first].tobytes(), marks[first].astype(np.int32).tobytes(), runs.tobytes(),
            steps.astype(width).tobytes(), count.astype(np.uint8).tobytes(), _bytes_of(gram, 5), _bytes_of(whole, 7),
        ]
    )


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    n, docs, width = (int(v) for v in np.frombuffer(data, np.int64, 3))
    place = 24

    def take(kind, count: int) -> np.ndarray:
        nonlocal place
        found = np.frombuffer(data, kind, count, place)
        place += found.nbytes
        return found

    ids, marks, runs = take(np.int64, docs), take(np.int32, docs), take(np.uint32, docs).astype(np.int64)
    steps, count = take(np.uint16 if width == 2 else np.uint32, n).astype(np.int64), take(np.uint8, n)
    gram = _from_bytes(data[place : place + 5 * n], 5)
    whole = _from_bytes(data[place + 5 * n : place + 12 * n], 7)
    sums = np.cumsum(steps)
    first = np.cumsum(runs) - runs
    at = (sums - np.repeat(sums[first] - steps[first], runs)).astype(np.int32)
    return np.repeat(ids, runs), np.repeat(marks, runs), at, count, gram, whole


def _by_document(ids, marks, at, count, extra=None) -> pd.DataFrame:
    """One row per document: its windows as pairs (first window, count), and extra columns likewise."""
    order = np.lexsort((at, marks, ids))
    ids, marks, at, count = ids[order], marks[order], at[order], count[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    first = np.append(np.flatnonzero(new), len(ids))
    pairs = np.stack([at, count], 1).astype(np.int64)
    frame = {
        "doc_id": ids[first[:-1]],
        "mark": marks[first[:-1]].astype(np.int32),
        "windows": [pairs[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)],
    }
    if extra is not None:
        extra = extra[order]
        frame["grams"] = [extra[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    return pd.DataFrame(frame)


def _crowded(gram: np.ndarray, ids: np.ndarray, crowd: int) -> np.ndarray:
    """Grams that `crowd` documents or more have records of."""
    grams, group, sizes = np.unique(gram, return_inverse=True, return_counts=True)
    rows = np.flatnonzero((sizes >= crowd)[group])
    rows = rows[np.lexsort((ids[rows], group[rows]))]
    new = np.ones(len(rows), bool)
    new[1:] = (group[rows][1:] != group[rows][:-1]) | (ids[rows][1:] != ids[rows][:-1])
    return grams[np.bincount(group[rows[new]], minlength=len(grams)) >= crowd]


def _records(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Maps documents to packed records by bucket; those known to be repeated go to odd buckets below 0, those of
    crowded grams to even ones, and a record of no windows to the bucket of such a gram.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(
                zip(batch["doc_id"], batch["mark"], (t.encode("utf-8", "replace") for t in batch["text"]), strict=True)
            )
            for part in by_bytes(rows, lambda r: len(r[2]), _BATCH_BYTES):
                yield from packed(part)

    def packed(rows: list) -> Iterator[pd.DataFrame]:
        found, done = [], 0
        for part in by_bytes(rows, lambda r: len(r[2]), _RUN_BYTES):
            one = anchors([r[2] for r in part])
            one["text"] = one["text"] + done
            done += len(part)
            found.append(one)
        joined = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        ids = np.array([r[0] for r in rows], np.int64)[joined["text"]]
        marks = np.array([r[1] for r in rows], np.int32)[joined["text"]]
        gram, whole, at, count = joined["gram"], joined["whole"], joined["at"], joined["count"]
        order = np.lexsort((ids, whole, gram))
        new = np.ones(len(order), bool)
        new[1:] = (gram[order][1:] != gram[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = ids > least
        bucket = (gram % _U(buckets)).astype(np.int64)
        bucket[again] = -1 - 2 * (ids[again] % buckets)
        crowded = _crowded(gram[~again], ids[~again], CROWD)
        apart = ~again & np.isin(gram, crowded)
        bucket[apart] = -2 - 2 * (ids[apart] % buckets)
        none = np.zeros(len(crowded), np.int64)
        bucket = np.append(bucket, (crowded % _U(buckets)).astype(np.int64))
        ids, marks = np.append(ids, none + _LAST), np.append(marks, none.astype(np.int32))
        at, count = np.append(at, none.astype(at.dtype)), np.append(count, none.astype(count.dtype))
        gram, whole = np.append(gram, crowded), np.append(whole, none.astype(_U))
        shown = gram // _U(buckets)  # with the bucket it gives the gram back, up to 40 bits
        order = np.lexsort((at, marks, ids, bucket))
        cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=bucket[order][:1] - 1)), len(order))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            o = order[a:b]
            out.append((int(bucket[o[0]]), _pack(ids[o], marks[o], at[o], count[o], shown[o], whole[o])))
        yield pd.DataFrame(out, columns=["bucket", "records"])

    return run


def _first_pass(frame: pd.DataFrame, most: int = CROWDED) -> pd.DataFrame:
    """Of a bucket's records: windows that are repeated, and windows to look at byte by byte (with grams)."""
    ids, marks, at, count, gram, whole = (np.concatenate(c) for c in zip(*map(_unpack, frame["records"]), strict=True))
    bucket = int(frame["bucket"].iat[0])
    if bucket < 0 and bucket % 2:
        return _by_document(ids, marks, at, count, None).assign(grams=None)
    if bucket < 0:
        return _by_document(ids, marks, at, count, np.full(len(ids), _CROWD))
    crowded, order = gram[count == 0], np.flatnonzero(count)
    order = order[np.lexsort((ids[order], whole[order], gram[order]))]
    ids, marks, at, count, gram, whole = (c[order] for c in (ids, marks, at, count, gram, whole))
    new_gram = np.ones(len(ids), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= whole[1:] != whole[:-1]
    starts = np.flatnonzero(new_gram)
    group = np.cumsum(new_gram) - 1
    least_of_gram = np.minimum.reduceat(ids, starts)[group]
    least = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
    repeated = ids > least
    asking = ~repeated & (ids > least_of_gram)
    asked = np.zeros(len(starts), bool)
    asked[group[asking]] = True
    marked = np.isin(gram[starts], crowded)
    # What a later document asks about may be in any differing record of the gram.
    looked_at = ~repeated & (asked[group] & (ids < _LAST) | marked[group]) | asking
    done = _by_document(ids[repeated], marks[repeated], at[repeated], count[repeated]).assign(grams=None)
    many = (marked | (np.diff(np.append(starts, len(ids))) >= most))[group]
    names = np.where(many, _CROWD, gram * _U(1 << 20) + _U(bucket & 0xFFFFF)).astype(_U)[looked_at]
    open_ = _by_document(ids[looked_at], marks[looked_at], at[looked_at], count[looked_at], names)
    return pd.concat([done, open_])


def _windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of records: its record and its place there."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _one_by_one(table: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of records as records of their own, and their buckets: by their bytes, or below 0 where a smaller
    document here has the window too.
    """
    head = np.ascontiguousarray(table[:, :40]).view(np.int64).reshape(-1, 5)
    owner, shift = _windows(head[:, 3])
    wide = np.zeros((len(owner), 8 * -(-WINDOW // 8)), np.uint8)
    wide[:, :WINDOW] = table[owner[:, None], 40 + shift[:, None] + np.arange(WINDOW)]
    digits = wide.view(_U)
    name = np.zeros(len(owner), _U)
    for digit in digits.T:
        name = _mix(name * _BASE + digit)
    ids = head[owner, 0]
    order = np.lexsort((ids, *digits.T, name))
    new = np.ones(len(order), bool)
    new[1:] = (digits[order][1:] != digits[order][:-1]).any(1)
    least = np.empty(len(order), np.int64)
    least[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = ids > least
    out = np.zeros((len(owner), 40 + _LONGEST), np.uint8)
    own = np.stack([ids, head[owner, 1], head[owner, 2] + shift, np.ones(len(owner), np.int64), name.view(np.int64)], 1)
    out[:, :40] = own.view(np.uint8).reshape(-1, 40)
    out[~again, 40 : 40 + WINDOW] = wide[~again, :WINDOW]
    return out, np.where(again, -1 - ids % buckets, (name % _U(buckets)).astype(np.int64))


def _segments(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Maps documents with windows to look at to the bytes under them, packed by bucket of the gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(zip(batch["doc_id"], batch["mark"], batch["packed"], batch["windows"], batch["grams"], strict=True))
            for part in by_bytes(rows, lambda r: sum(map(len, r[3])) * 6, _BATCH_BYTES):
                table = table_of(part)
                names = np.ascontiguousarray(table[:, 32:40]).view(_U).reshape(-1)
                plain = names != _CROWD
                yield packed(table[plain], (_mix(names[plain]) % _U(buckets)).astype(np.int64))
                crowd = table[~plain]
                for a in range(0, len(crowd), _CROWD_RECORDS):
                    yield packed(*_one_by_one(crowd[a : a + _CROWD_RECORDS], buckets))

    def table_of(rows: list) -> np.ndarray:
        parts = []
        for doc_id, mark, data, windows, grams in rows:
            text = np.frombuffer(zlib.decompress(data) + bytes(_LONGEST), np.uint8)
            pairs = np.frombuffer(b"".join(windows), np.int64).reshape(-1, 2)
            names = np.frombuffer(b"".join(grams), _U)
            head = np.empty((len(pairs), 5), np.int64)
            head[:, 0], head[:, 1], head[:, 2:4], head[:, 4] = doc_id, mark, pairs, names.view(np.int64)
            parts.append(np.hstack([head.view(np.uint8).reshape(len(pairs), 40), text[pairs[:, :1] + np.arange(_LONGEST)]]))
        return np.concatenate(parts)

    def packed(table: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=bucket[order][:1] - 1)), len(order))
        return pd.DataFrame(
            [(int(bucket[order[a]]), table[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
            columns=["bucket", "segments"],
        )

    return run


def radix_groups(group: np.ndarray, digit: Callable[[int, np.ndarray], np.ndarray], ids: np.ndarray, digits: int):
    """(rows, least): rows whose digits all equal those of a row of the same group and another id, and the
    smallest id of such equal rows. Each pass orders the rows left by one more digit and drops those whose
    group has come down to one id.
    """
    rows = np.arange(len(group))
    for i in range(digits + 1):
        if i:
            value = digit(i - 1, rows)
            order = np.lexsort((value, group))
            new = np.ones(len(order), bool)
            new[1:] = (value[order][1:] != value[order][:-1]) | (group[order][1:] != group[order][:-1])
        else:
            order = np.argsort(group, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = group[order][1:] != group[order][:-1]
        if not len(order):
            break
        rows, starts = rows[order], np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least, most = np.minimum.reduceat(ids[rows], starts), np.maximum.reduceat(ids[rows], starts)
        stays = (least < most)[group]
        rows, group, smallest = rows[stays], group[stays], least[group][stays]
    return (rows, smallest) if len(rows) else (rows, np.empty(0, np.int64))


def _last_passes(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows of a bucket's segments that a smaller document has too."""
    table = np.frombuffer(b"".join(frame["segments"]), np.uint8).reshape(-1, 40 + _LONGEST)
    head = np.ascontiguousarray(table[:, :40]).view(np.int64).reshape(-1, 5)
    if frame["bucket"].iat[0] < 0:
        return _by_document(*head[:, :4].T)
    owner, shift = _windows(head[:, 3])
    body = np.ascontiguousarray(table[:, 40:])

    def digit(i: int, rows: np.ndarray) -> np.ndarray:
        begin = shift[rows] + min(8 * i, WINDOW - 8)
        return body[owner[rows, None], begin[:, None] + np.arange(8)].copy().view(">u8").reshape(-1).astype(_U)

    ids = head[owner, 0]
    rows, least = radix_groups(head[owner, 4], digit, ids, -(-WINDOW // 8))
    rows = rows[ids[rows] > least]
    at = head[owner[rows], 2] + shift[rows]
    return _by_document(ids[rows], head[owner[rows], 1], at, np.ones(len(rows), np.int64))


def _spans(windows: list[bytes]) -> np.ndarray:
    """Maximal (start, stop) of the bytes under windows given as pairs (first window, count)."""
    pairs = np.frombuffer(b"".join(windows), np.int64).reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, stop = pairs[:, 0], np.maximum.accumulate(pairs.sum(1) - 1 + WINDOW)
    new = np.append(True, start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return np.stack([start[first], stop[np.append(first[1:] - 1, len(stop) - 1)]], 1)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for data, windows in zip(batch["packed"], batch["windows"], strict=True):
            text = zlib.decompress(data)
            spans = _spans([] if windows is None else list(windows))
            edges = [0, *spans.ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed = len(text) - len(kept)
            out.append((len(text), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept))
        columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield batch[["doc_id"]].reset_index(drop=True).join(pd.DataFrame(out, columns=columns))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id (a missing one as the last), mark (a hash to tell rows of one id apart) and text."""
    text = text_of(text_column)
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc_id"), F.hash(text).alias("mark"), text.alias("text")
    )


def _packed(keyed: DataFrame) -> DataFrame:
    """doc_id, mark and the compressed text, for shuffles."""

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [zlib.compress(t.encode("utf-8", "replace"), 1) for t in batch["text"]]
            yield batch[_KEYS].assign(packed=packed)

    return keyed.mapInPandas(compress, "doc_id long, mark int, packed binary")


def repeated_windows(keyed: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, mark, windows): for each document with repeated windows, lists of packed (first, count)."""
    size = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(_BUCKETS * partitions, -(-size // _BUCKET_BYTES))
    tasks = max(partitions, -(-size // _TASK_BYTES))
    found = "doc_id long, mark int, windows binary"

    def first_pass(frame: pd.DataFrame) -> pd.DataFrame:
        return _first_pass(frame, CROWDED)

    records = keyed.where(F.octet_length("text") >= WINDOW).mapInPandas(
        _records(buckets), "bucket int, records binary"
    )
    first = stage(records.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(first_pass, f"{found}, grams binary"))
    open_ = (
        first.where("grams is not null")
        .groupBy(*_KEYS)
        .agg(F.collect_list("windows").alias("windows"), F.collect_list("grams").alias("grams"))
        .withColumnsRenamed({k: f"_{k}" for k in _KEYS})
    )
    texts = _packed(keyed)
    looked_up = texts.join(open_, (F.col("doc_id") == F.col("_doc_id")) & (F.col("mark") == F.col("_mark")))
    last = stage(
        looked_up.select(*_KEYS, "packed", "windows", "grams")
        .mapInPandas(_segments(buckets), "bucket int, segments binary")
        .repartition(tasks, "bucket")
        .groupBy("bucket")
        .applyInPandas(_last_passes, found)
    )
    return (
        first.where("grams is null")
        .select(*_KEYS, "windows")
        .unionByName(last)
        .groupBy(*_KEYS)
        .agg(F.collect_list("windows").alias("windows"))
    )


def _flag(frame: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*(frame[k] for k in _KEYS)), F.lit(FLAGS))


def cut_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row.

    Texts are shuffled only if their hash has the flag of a document with repeats; there are at most FLAGS.
    """
    ship(docs.sparkSession)
    keyed = _keyed(docs, id_column, text_column)
    windows = stage(repeated_windows(keyed, buckets))
    flags = windows.select(_flag(windows).alias("flag")).distinct()
    flagged = keyed.withColumn("flag", _flag(keyed)).join(
        F.broadcast(flags.withColumn("_hit", F.lit(True))), "flag", "left"
    )
    whole = flagged.where("_hit is null").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.encode("text", "UTF-8").alias("kept"),
    )
    texts = _packed(flagged.where("_hit").select(*_KEYS, "text"))
    cut = (
        texts.join(windows, same(texts, windows, _KEYS), "left")
        .select(texts["doc_id"], "packed", "windows")
        .mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
    return whole.unionByName(cut).withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))
