"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents longer than a sequence are cut into full pieces behind a first piece that may be shorter. What is
packed is the histogram of piece lengths, which has at most `capacity` entries however many documents there
are: patterns of up to three lengths that fill a sequence are enumerated, non-negative least squares finds how
often to use each so that together they use up the histogram, the counts are rounded down to what is there, and
the residual pieces go, longest first, to the fullest sequence with room. The plan is a table of slots per
length; each piece finds its own by its position among the pieces of its length, so pieces never meet in a task.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; pieces
alike in all columns may swap places; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..session import stage
from .common import ship

CAPACITY = 2048
END = 0
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"

_SPACE_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
_ENDS = ".,:;!?|"  # ASCII that is neither letter, digit, blank nor apostrophe, common at the end of words
# Fixed value: the pattern by which byte-level BPE cuts text.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Which letter stands for which byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    table, unused = {}, iter(range(256, 512))
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        table[b] = chr(b if printable else next(unused))
    return table


class Tokens(dict):
    """Token ids of texts by a byte-level BPE; a dict from words (with a space before) to the bytes of their ids.

    Byte-level BPE never joins across a space that stands before a word, so a text may be cut there and its
    words looked up one by one. A text where a space precedes white space or ends the text, or that holds the
    string of an added token (which is that token), is encoded whole.
    Words and the parts they are cut into are remembered, up to a bound and unless they are long, until `forget`;
    that changes no result. A part that is a word with a space before is remembered as that word only.
    """

    WORDS = 750_000
    PARTS = 150_000
    LETTERS = 40  # longer words and parts hardly come again, and would make the bounds on their number worthless

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.cut = regex.compile(_CUT).findall
        self.parts: dict[str, bytes] = {}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)").search
        sample = "It's an Übung, (no. 12)!\n done"
        if self.of(sample) != self._whole(sample):
            raise ValueError(f"{path} is not a byte-level BPE without normalisation")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encoded(self, part: str) -> bytes:
        """Ids of one piece of the pattern."""
        if part.isascii() and part[1:].isalpha() and part[0] == " ":
            written = self.space + part[1:]
        else:
            written = part.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _part(self, part: str) -> bytes:
        """The same, remembered."""
        found = self.parts.get(part)
        if found is None:
            if part[0] == " " and self._plain(part[1:]):
                return self[part[1:]]
            found = self._encoded(part)
            if len(part) <= self.LETTERS:
                if len(self.parts) >= self.PARTS:
                    self.parts.clear()
                self.parts[part] = found
        return found

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether a space and the word are surely one piece of the pattern."""
        return word.isalpha() and (word.isascii() or (word.isprintable() and max(word) < "\u0250"))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._part, self.cut(chunk)))

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_ENDS)
        if not self._plain(letters):
            found = self._chunk(f" {word}")
        elif len(letters) < len(word):
            found = self[letters] + self._part(word[len(letters) :])
        else:
            found = self._encoded(f" {word}")
        if len(word) <= self.LETTERS:
            if len(self) >= self.WORDS:
                self.clear()
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.parts.clear()

    def of(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if _SPACE_BEFORE_SPACE.search(text) or self.added(text):
            return self._whole(text)
        first, *words = text.split(" ")
        return self._chunk(first) + b"".join(map(self.__getitem__, words))


_tokens: dict[str, Tokens] = {}  # of this worker process, by tokenizer file


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


@contextmanager
def remembering(path: str) -> Iterator[Tokens]:
    """Tokens that remember words within the block only.

    A worker process serves later stages and queries too, or waits for them, beside others like it.
    """
    encoder = tokens(path)
    try:
        yield encoder
    finally:
        encoder.forget()


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n_tokens % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; tokenizer is the path of its file."""
    ship(docs.sparkSession)
    given = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    end = array("I", [END]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(tokenizer) as encoder:
            for batch in batches:
                rows = []
                for n, text in enumerate(batch.column("text")):  # one text at a time leaves Arrow's memory
                    ids = encoder.of(text.as_py()) + end
                    for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        rows.append((n, i, start, length, crc))
                table = np.array(rows, np.int64).reshape(-1, 5)
                columns = [batch.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32))]
                columns += [pa.array(table[:, j]) for j in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return given.mapInArrow(pieces, PIECES.format(id=given.schema["doc_id"].dataType.simpleString()))


@dataclass
class Pattern:
    lengths: tuple[int, ...]  # longest first
    times: int


def _enumerate(lengths: np.ndarray, capacity: int, step: int) -> np.ndarray:
    """Patterns of two and three of the lengths that fill a sequence exactly, a row each, 0 for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    longest = lengths[lengths >= capacity / 3]
    # The second length of a triple is taken from every step-th one, the third completes the sequence.
    seconds = np.unique(np.concatenate([[0], lengths[::step]]))
    a, b = (x.ravel() for x in np.meshgrid(longest, seconds, indexing="ij"))
    c = capacity - a - b
    fits = (c > 0) & (c <= a) & ((b == 0) | (c <= b)) & there[np.maximum(c, 0)] & (b <= a)
    return np.stack([a[fits], b[fits], c[fits]], 1)


def least_squares(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring patterns @ x nearest to the wanted histogram.

    Accelerated projected gradient; longer pieces weigh more, as they are harder to place elsewhere.
    """
    size = len(wanted)
    weight = np.sqrt(np.arange(size) / size)
    weight[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, j], x, size) for j in range(patterns.shape[1]))

    def gradient(x: np.ndarray) -> np.ndarray:
        off = (used(x) - wanted) * weight**2
        return off[patterns].sum(1)

    vector = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue gives the step
        vector = (lambda g: g / np.linalg.norm(g))((used(vector) * weight**2)[patterns].sum(1))
    step = 1 / max(float(vector @ (used(vector) * weight**2)[patterns].sum(1)), 1e-9)
    x = ahead = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - step * gradient(ahead), 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, step: int = 8) -> list[Pattern]:
    """Patterns that together hold exactly the pieces of the histogram {length: count}."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    packed = [Pattern((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = _enumerate(np.flatnonzero(left), capacity, step)
    fitted: list[Pattern] = []
    if len(patterns):
        times = np.rint(least_squares(patterns, left.astype(float))).astype(np.int64)
        for i in np.argsort(-times, kind="stable"):
            lengths = [int(v) for v in patterns[i] if v]
            n = min(int(times[i]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                for v in lengths:
                    left[v] -= n
                fitted.append(Pattern(tuple(sorted(lengths, reverse=True)), n))
    return packed + fitted + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Residual pieces, longest first, each into the fullest open sequence with room; counts at a time."""
    open_by_room: dict[int, list[Pattern]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(pattern: Pattern) -> None:
        room = capacity - sum(pattern.lengths)
        open_by_room.setdefault(room, []).append(pattern)
        rooms[room] = True

    for length in np.flatnonzero(left)[::-1]:
        length, n = int(length), int(left[length])
        while n:
            room = length + int(rooms[length:].argmax())
            if not rooms[room]:
                per = capacity // length
                if n >= per:
                    put(Pattern((length,) * per, n // per))
                    n %= per
                else:
                    put(Pattern((length,) * n, 1))
                    n = 0
                continue
            pattern = open_by_room[room].pop()
            rooms[room] = bool(open_by_room[room])
            m = min(n, pattern.times)
            if m < pattern.times:
                put(Pattern(pattern.lengths, pattern.times - m))
            put(Pattern((*pattern.lengths, length), m))
            n -= m
    return [p for patterns in open_by_room.values() for p in patterns]


def _slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Per length and pattern: the first position it serves, its sequences and places in them."""
    rows, served, sequence = [], {}, 0
    for pattern in patterns:
        offset = 0
        for length in sorted(set(pattern.lengths), reverse=True):
            per = pattern.lengths.count(length)
            rows.append((length, served.get(length, 0), sequence, per, offset))
            served[length] = served.get(length, 0) + per * pattern.times
            offset += per * length
        sequence += pattern.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "per", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """Add sequence_id and offset to a frame of pieces of 1 to capacity tokens."""
    pieces = stage(pieces)
    histogram = {
        r[0]: r[1] for r in pieces.groupBy(length_column).count().collect()
    }  # at most `capacity` rows
    slots = _slots(plan(histogram, capacity))
    lengths = np.array(sorted(histogram), np.int64)
    before = np.cumsum([0, *(histogram[v] for v in lengths)])[:-1]
    keys = slots["length"] << 44 | slots["first"]
    order = [length_column, *(c for c in pieces.columns if c != length_column)]
    placed = global_position(pieces, [F.col(c) for c in order])
    names = pieces.columns

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch[length_column].to_numpy(np.int64)
            position = batch["_row"].to_numpy(np.int64) - before[np.searchsorted(lengths, length)]
            at = np.searchsorted(keys, length << 44 | position, "right") - 1
            nth = position - slots["first"][at]
            yield batch[names].assign(
                sequence_id=slots["sequence"][at] + nth // slots["per"][at],
                offset=slots["offset"][at] + nth % slots["per"][at] * length,
            )

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    return placed.drop("_rows_total").mapInPandas(assign, schema)
