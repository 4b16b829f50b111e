"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs: runs of words that end where the hash of a word says so (and, where no
word does for long, by count from the last that did, so that an edit moves no cuts beyond the next). Short texts
are cut finer, so that they have about PARAGRAPHS of them; from PARAGRAPHS * COARSEST words on a paragraph has about COARSEST words, and their number grows with the text.
The set of their digests goes into a table of cells;
each digest is added to three of them, one in each third: a count, the digests xored, and their check hashes
xored. Tables subtract cell by cell. What remains are the digests that only one side has, and these are peeled:
a cell with one digest gives it away, it is taken out of its other cells, and so on until all are empty. The
first table is chosen by an estimate of the difference from the digests of one residue. If some are left, the
subtraction is repeated with tables of twice the size, and beyond the last the digest sets are subtracted directly.
The likeness of two texts is the shared part of their joint digests.

All of it is DataFrame functions on one row; a row holds the digests of the texts that it compares.

Defined results: a null text counts as empty; texts without words have no paragraphs, and two such texts are
alike (1); equal texts have equal fingerprints; the next document is that of the next smaller id, after the
last the first, and documents without an id come last; rows alike in id and text count as one document, each
with the same result; a single document is its own next; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..session import stage
from .common import SPACES, WORD, text_of

PARAGRAPHS = 24
COARSEST = 32  # words in a paragraph of a long text, about; a power of two
SIZES = (24, 48, 96, 192, 384)  # cells, in thirds
SAMPLE = 4  # one digest in so many tells how large a difference is
ROUNDS = 12
LONGEST = 4  # times the usual length after which a run without such words is cut
_CELL = "struct<n:int,key:bigint,check:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(**columns: Column) -> Column:
    """A struct whose field names hold inside nested lambdas too."""
    return F.named_struct(*(part for name, value in columns.items() for part in (F.lit(name), value)))


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def coarseness(n_words: Column) -> Column:
    """A word in so many ends a paragraph: 1 up to PARAGRAPHS words, then powers of two up to COARSEST."""
    steps = F.ceil(F.log(2.0, F.greatest(n_words, F.lit(1)) / PARAGRAPHS) - 1e-9)
    return F.least(F.pow(F.lit(2.0), F.greatest(steps, F.lit(0))).cast("long"), F.lit(COARSEST).cast("long"))


def paragraphs(hashes: Column, every: Column) -> Column:
    """Distinct digests of the paragraphs of hashed words."""
    # Each argument is computed once, whatever expression it is.
    return let(hashes, lambda words: let(every, lambda step: _cut(words, step)))


def _cut(hashes: Column, every: Column) -> Column:
    n = F.size(hashes)
    longest = every * LONGEST

    def cut(places: Column) -> Column:
        def between(end: Column, i: Column) -> Column:
            def pieces(begin: Column) -> Column:
                return F.transform(
                    F.sequence(F.lit(0).cast("long"), F.floor((end - begin - 1) / longest)),
                    lambda k: let(
                        (begin + k * longest).cast("int"),
                        lambda at: F.xxhash64(F.slice(hashes, at + 1, F.least(end - at, longest).cast("int"))),
                    ),
                )

            return let(F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1)), pieces)

        return F.array_distinct(F.flatten(F.transform(places, between)))

    ends = F.filter(
        F.sequence(F.lit(1), n), lambda p: (F.pmod(F.get(hashes, p - 1), every) == 0) | (p == n)
    )
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(let(ends, cut))


def _placed(digests: Column, cells: int) -> Column:
    """Signed digests as struct(n, key, check) with the place of their cell in each third."""
    third = cells // 3
    return F.transform(
        digests,
        lambda e: fields(
            n=e["n"],
            key=e["key"],
            check=F.xxhash64(e["key"], F.lit(1)),
            **{f"at{s}": F.pmod(F.xxhash64(e["key"], F.lit(2 + s)), F.lit(third)).cast("int") for s in range(3)},
        ),
    )


def _table(placed: Column, cells: int) -> Column:
    def add(cell: Column, e: Column) -> Column:
        return fields(
            n=cell["n"] + e["n"],
            key=cell["key"].bitwiseXOR(e["key"]),
            check=cell["check"].bitwiseXOR(e["check"]),
        )

    zero = F.lit(0).cast("long")
    nothing = fields(n=F.lit(0), key=zero, check=zero).cast(_CELL)

    def third(s: int) -> Column:
        """Digests in the order of their cells; each cell is a run of them."""

        def runs(ordered: Column) -> Column:
            def cut(at: Column, back: Column) -> Column:
                def cell(c: Column) -> Column:
                    def run(begin: Column) -> Column:
                        end = F.size(at) - F.array_position(back, c) + 1
                        own = F.slice(ordered, begin, (end - begin + 1).cast("int"))
                        return F.when(begin == 0, nothing).otherwise(F.aggregate(own, nothing, add))

                    return let(F.array_position(at, c).cast("int"), run)

                return F.transform(F.sequence(F.lit(0), F.lit(cells // 3 - 1)), cell)

            return let(F.transform(ordered, lambda e: e["at"]), lambda at: let(F.reverse(at), lambda back: cut(at, back)))

        own = F.transform(placed, lambda e: fields(at=e[f"at{s}"], n=e["n"], key=e["key"], check=e["check"]))
        return let(F.sort_array(own), runs)

    return F.concat(third(0), third(1), third(2))


def sketch(digests: Column, cells: int = SIZES[0]) -> Column:
    """The table of a set of digests: array<struct<n, key, check>>."""
    signed = F.transform(digests, lambda d: fields(n=F.lit(1), key=d))
    return let(_placed(signed, cells), lambda placed: _table(placed, cells))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: fields(
            n=x["n"] - y["n"],
            key=x["key"].bitwiseXOR(y["key"]),
            check=x["check"].bitwiseXOR(y["check"]),
        ),
    )


def _without(table: Column, placed: Column, third: int) -> Column:
    """A table less some digests; only the cells that these are in are computed."""

    def within(e: Column, i: Column) -> Column:
        return (e["at0"] == i) | (e["at1"] + third == i) | (e["at2"] + 2 * third == i)

    def less(cell: Column, e: Column) -> Column:
        return fields(
            n=cell["n"] - e["n"],
            key=cell["key"].bitwiseXOR(e["key"]),
            check=cell["check"].bitwiseXOR(e["check"]),
        )

    def cell_less(touched: Column) -> Column:
        def one(cell: Column, i: Column) -> Column:
            left = F.aggregate(F.filter(placed, lambda e: within(e, i)), cell, less)
            return F.when(F.array_contains(touched, i), left).otherwise(cell)

        return F.transform(table, one)

    places = F.flatten(F.transform(placed, lambda e: F.array(e["at0"], e["at1"] + third, e["at2"] + 2 * third)))
    return let(places, cell_less)


def peel(difference: Column, cells: int) -> Column:
    """The digests that a subtracted table holds, as structs: n is 1 for the first side, -1 for the other, key the
    digest. Null if some cannot be recovered."""

    def pure(cell: Column) -> Column:
        return (F.abs(cell["n"]) == 1) & (F.xxhash64(cell["key"], F.lit(1)) == cell["check"])

    def step(state: Column, _: Column) -> Column:
        def take_out(found: Column) -> Column:
            rest = let(_placed(found, cells), lambda placed: _without(state["cells"], placed, cells // 3))
            return F.when(F.size(found) == 0, state).otherwise(
                fields(cells=rest, found=F.concat(state["found"], found))
            )

        recovered = F.array_distinct(
            F.transform(
                F.filter(state["cells"], pure), lambda c: fields(n=c["n"], key=c["key"])
            )
        )
        return let(recovered, take_out)

    found = "array<struct<n:int,key:bigint>>"
    start = fields(cells=difference, found=F.array().cast(found)).cast(f"struct<cells:array<{_CELL}>,found:{found}>")
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(
        done, lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0)), s["found"])
    )


def _apart(a: Column, b: Column) -> Column:
    """What `peel` gives, from the sets themselves."""

    def side(x: Column, y: Column, n: int) -> Column:
        return F.transform(F.array_except(x, y), lambda d: fields(n=F.lit(n), key=d))

    return F.concat(side(a, b, 1), side(b, a, -1))


def estimated_difference(a: Column, b: Column) -> Column:
    """About how many digests only one set has: those of one residue, times SAMPLE; at least what the sizes tell."""

    def sampled(digests: Column) -> Column:
        return F.filter(digests, lambda d: F.pmod(d, F.lit(SAMPLE)) == 0)

    return F.greatest(F.size(_apart(sampled(a), sampled(b))) * SAMPLE, F.abs(F.size(a) - F.size(b)))


def difference(a: Column, b: Column, sizes: Sequence[int] = SIZES) -> Column:
    """The digests in one set but not in the other, as `peel` gives them, by tables that double until one peels.

    The first has room for the estimated difference; the result does not depend on the estimate. Beyond the last
    size the sets are subtracted directly.
    """

    def attempt(cells: int, expected: Column) -> Column:
        def unless_full(difference: Column) -> Column:
            # Each digest left adds at most 3 to the counts; a table much fuller than it has cells is not peeled.
            held = F.aggregate(difference, F.lit(0), lambda t, c: t + F.abs(c["n"]))
            return F.when(held <= 3 * cells, peel(difference, cells))

        tried = let(subtract(sketch(a, cells), sketch(b, cells)), unless_full)
        return F.when(expected * 3 <= cells * 2, tried)

    return let(
        estimated_difference(a, b),
        lambda expected: F.coalesce(*(attempt(cells, expected) for cells in sizes), _apart(a, b)),
    )


def difference_size(a: Column, b: Column, sizes: Sequence[int] = SIZES) -> Column:
    """The number of digests in one set but not in the other."""
    return F.size(difference(a, b, sizes))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the joint digests of two sets, from their sizes and that of their difference."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(
        let(difference_size(a, b), lambda d: (both - d) / (both + d)).cast("double")
    )


def written(digests: Column, every: Column) -> Column:
    """The fingerprint as text: coarseness, then each cell's count, key and check in hex."""
    cell = F.transform(
        sketch(digests),
        lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(
            F.concat_ws(".", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"].bitwiseAND(F.lit(0xFFFFFFFF))))
        ),
    )
    return F.concat(every.cast("string"), F.lit(":"), F.array_join(cell, ","))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    hashes = docs.select(F.col(id_column).alias("doc_id"), word_hashes(text_of(text_column)).alias("_h"))
    every = coarseness(F.size("_h"))
    return hashes.select("doc_id", "_h", every.alias("_every")).select(
        "doc_id", written(paragraphs(F.col("_h"), F.col("_every")), F.col("_every")).alias("fingerprint")
    )


_KEYS = ["k1", "k2"]


def versions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document.

    doc_id, text, n_chars, every (its coarseness), edited, next_every, next_cut (the next document's paragraphs at
    the coarser level of the two), copies (rows it stands for). The texts are shuffled once by key; from there
    each sends its predecessor no more than the part that is put in and a few digests.
    """
    text = text_of(text_column)
    given = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).select(
        F.xxhash64("doc_id", "text").alias("k1"), F.hash("doc_id", "text").alias("k2"), "doc_id", "text"
    )
    n_words = F.regexp_count("text", F.lit(WORD))
    known = given.select(*_KEYS, "doc_id", F.length("text").alias("n_chars"), coarseness(n_words).alias("every"))
    listed = known.groupBy(*_KEYS, "doc_id").agg(
        F.max("n_chars").alias("n_chars"), F.max("every").alias("every"), F.count(F.lit(1)).alias("copies")
    )
    placed = stage(global_position(listed, [F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")]))
    before = placed.select(
        ((F.col("_row") + 1) % F.col("_rows_total")).alias("_row"),
        *(F.col(c).alias(f"{c}_before") for c in [*_KEYS, "n_chars", "every"]),
    )
    order = placed.join(before, "_row").drop("_row", "_rows_total")
    # Both uses need the same columns of the texts, so that Spark shuffles them once for both.
    full = given.select(*_KEYS, "text").dropDuplicates(_KEYS).join(order, _KEYS)
    sent = full.select(
        F.col("k1_before").alias("k1"),
        F.col("k2_before").alias("k2"),
        F.left("text", F.floor(F.col("n_chars_before") / 3).cast("int")).alias("head"),
        F.col("every").alias("next_every"),
        let(
            word_hashes(F.col("text")), lambda words: paragraphs(words, F.greatest("every", "every_before"))
        ).alias("next_cut"),
    )
    third = F.floor(F.col("n_chars") / 3).cast("int")
    return full.join(sent, _KEYS).select(
        "doc_id",
        "text",
        "n_chars",
        "every",
        F.concat(F.left("text", F.col("n_chars") - third), "head").alias("edited"),
        "next_every",
        "next_cut",
        "copies",
    )
