"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: strings that every match must contain. The
index lists, for every trigram that some rule's query names, the documents that hold it (in lower case). The
posting lists of a query are intersected by document, and only the documents that come through are searched
with the pattern itself; a rule without mandatory trigrams searches every document. Index, intersection and
search are DataFrame functions.

Defined results: a null text counts as empty; documents are indexed under a hash of their id, so rows that share
an id (or have none) are searched if one of them is a candidate, which changes no result; matches are leftmost
and do not overlap within a kind; repeated rows are searched each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as rx
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group of it that must have at least so many characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def either_case(text: str) -> str:
    """A pattern for text with letters in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

# The three kinds every scan has, in their order.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # The same spans as [0-9a-f]+ with 16 characters or more: a run is taken whole either way.
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)

# A query is a set of alternatives, each a set of trigrams that must all be there; {{}} holds for any text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
_MOST_STRINGS = 64


def _all_of(a: Query, b: Query) -> Query:
    return _least({x | y for x in a for y in b})


def _least(alternatives: Iterable[frozenset[str]]) -> Query:
    """Without the alternatives that another one implies."""
    every = set(alternatives)
    return frozenset(x for x in every if not any(y < x for y in every))


def _trigrams(strings: set[str]) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(item) -> set[str] | None:
    """All strings that the item matches, in lower case, if they are few."""
    kind, value = item
    if kind is rx.LITERAL:
        return {chr(value).lower()}
    if kind is rx.IN and all(k is rx.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind is rx.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is rx.BRANCH:
        parts = [_sequence_strings(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is rx.MAX_REPEAT and value[1] <= 8:
        low, high, inner = value
        one = _sequence_strings(inner)
        if one is None or len(one) ** high > _MOST_STRINGS:
            return None
        powers = [{""}]
        for _ in range(high):
            powers.append({a + b for a in powers[-1] for b in one})
        return set().union(*powers[low:])
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for item in items:
        one = _strings(item)
        if one is None or len(found) * len(one) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _query(items) -> Query:
    query, run = ANY, {""}
    for item in items:
        one = _strings(item)
        if one is not None and len(run) * len(one) <= _MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        query, run = _all_of(query, _trigrams(run)), {""}
        kind, value = item
        if kind is rx.SUBPATTERN:
            query = _all_of(query, _query(value[-1]))
        elif kind is rx.BRANCH:
            query = _all_of(query, _least(x for p in value[1] for x in _query(p)))
        elif kind is rx.MAX_REPEAT and value[0] > 0:
            query = _all_of(query, _query(value[2]))
    return _all_of(query, _trigrams(run))


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that any text with a match must contain."""
    return _query(_parser.parse(pattern))


class Index:
    """Which trigrams the rules ask for, and how their posting lists are built and intersected."""

    BITS = 60  # of a mask column

    def __init__(self, rules: Sequence[Rule]):
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.trigrams = sorted({t for q in self.queries.values() for part in q for t in part})

    def postings(self, docs: DataFrame, key: Column, text: Column) -> DataFrame:
        """The inverted index: (trigram, key) for every document and trigram of the rules that it holds."""
        folded = docs.select(key.alias("key"), F.lower(text).alias("_folded"))
        held = F.array(*(F.when(F.contains("_folded", F.lit(t)), F.lit(i)) for i, t in enumerate(self.trigrams)))
        return folded.select("key", F.explode(F.array_compact(held)).alias("trigram"))

    def _words(self) -> range:
        return range(-(-len(self.trigrams) // self.BITS))

    def intersect(self, postings: DataFrame) -> DataFrame:
        """The posting lists merged by document: key and one bit per trigram."""

        def bits(word: int) -> Column:
            place = F.col("trigram") - word * self.BITS
            one = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
            return F.bit_or(F.when((place >= 0) & (place < self.BITS), one).otherwise(F.lit(0).cast("long")))

        return postings.groupBy("key").agg(*(bits(w).alias(f"_mask_{w}") for w in self._words()))

    def candidate(self, kind: str) -> Column:
        """Whether the masks of a document satisfy the query of a rule; true for rules without trigrams."""
        query = self.queries[kind]
        if query == ANY:
            return F.lit(True)
        parts = []
        for part in sorted(map(sorted, query)):
            places = [self.trigrams.index(t) for t in part]
            tests = []
            for w in self._words():
                need = sum(1 << (p - w * self.BITS) for p in places if w * self.BITS <= p < (w + 1) * self.BITS)
                if need:
                    mask = F.coalesce(F.col(f"_mask_{w}"), F.lit(0).cast("long"))
                    tests.append(mask.bitwiseAND(F.lit(need).cast("long")) == need)
            parts.append(reduce(Column.__and__, tests))
        return reduce(Column.__or__, parts)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in a text, in code points, end exclusive.

    The text between matches and the matches themselves add up to the positions.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, 0)
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches)).alias("before"),
        matches.alias("match"),
        F.regexp_extract_all(text, pattern, rule.group).alias("counted"),
    )
    empty = F.array().cast("array<struct<start:int,end:int,counted:int>>")

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + F.length(part["before"])
        end = start + F.length(part["match"])
        one = F.struct(start.alias("start"), end.alias("end"), F.length(part["counted"]).alias("counted"))
        return F.struct(end.alias("at"), F.concat(so_far["found"], F.array(one)).alias("found"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("found")), step)
    return F.filter(walked["found"], lambda s: s["counted"] >= rule.least)


def scan(
    docs: DataFrame,
    rules: Sequence[Rule] = BASE + MORE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id and spans: array<struct<start, rank, kind, end>>, by start and then rank, the rule's place."""
    given = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(F.col(id_column)).alias("key"),
        text_of(text_column).alias("text"),
    )
    index = Index(rules)
    if index.trigrams:
        masks = index.intersect(index.postings(given, F.col("key"), F.col("text")))
        given = given.join(masks, "key", "left")
    found = given.select(
        "doc_id",
        *(
            F.when(index.candidate(r.kind), spans(F.col("text"), r))
            .otherwise(F.array().cast("array<struct<start:int,end:int,counted:int>>"))
            .alias(f"_found_{i}")
            for i, r in enumerate(rules)
        ),
    )
    labelled = (_labelled(F.col(f"_found_{i}"), i, r.kind) for i, r in enumerate(rules))
    return found.select("doc_id", F.array_sort(F.concat(*labelled)).alias("spans"))


def _labelled(found: Column, rank: int, kind: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
