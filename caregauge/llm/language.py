"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams in order of frequency. A text is given
the language whose profile its own list fits best: the distance sums, over the text's n-grams, how far each
is out of place, and the full length of a profile for one that the language lacks.

Profiles count every training text whole, in partial counts per task that Spark adds up; only the profiles
themselves come to the driver (length x languages).

Defined results: a null text or one without a letter is `und` with score 0; equal distances go to the smaller
language name; training rows with a null language or text teach nothing; with nothing learned every text is
`und`; an empty table gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, ship, whole_rows

PROFILE = 400
SIZES = (1, 2, 3)
UNKNOWN = "und"
_BITS = 21  # of a code point; three fit a signed 64-bit key
_BATCH_CHARS = 2_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """The text's letters in lower case as code point + 1, each run of anything else as one 1."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]  # the last other character before a letter
    keep[-1] = True
    codes = np.where(is_letter, points, 0)[keep].astype(np.int64) + 1
    return codes


def ngram_keys(codes: np.ndarray) -> np.ndarray:
    """All n-grams as integers, but for those of blanks only."""
    found = [codes[codes > 1]]
    for n in SIZES[1:]:
        key = codes[: len(codes) - n + 1]
        for i in range(1, n):
            key = (key << _BITS) | codes[i : len(codes) - n + 1 + i]
        found.append(key)
    return np.concatenate(found)


def ranked(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, commonest first; ties by key."""
    values, counts = np.unique(keys, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Profiles of all languages in one table: sorted n-grams, and each one's rank per language."""

    def __init__(self, lists: dict[str, list[int]], length: int = PROFILE):
        self.names = sorted(lists)
        self.length = length
        grams = np.unique(np.array([g for v in lists.values() for g in v], np.int64))
        # One row more for n-grams that no language has.
        self.ranks = np.full((len(grams) + 1, len(self.names)), length, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(grams, np.array(lists[name], np.int64)), j] = np.arange(
                len(lists[name])
            )
        self.grams = grams

    def classify(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names:
            return UNKNOWN, 0.0
        codes = letter_codes(text)
        if not (codes > 1).any():
            return UNKNOWN, 0.0
        own = ranked(ngram_keys(codes), self.length)
        at = np.minimum(np.searchsorted(self.grams, own), max(len(self.grams) - 1, 0))
        rows = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[rows]
        apart = np.where(
            ranks == self.length, self.length, np.abs(ranks - np.arange(len(own))[:, None])
        ).sum(0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (len(own) * self.length))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for run in by_bytes(list(texts), len, _BATCH_CHARS):
                keys, counts = np.unique(ngram_keys(letter_codes("\n".join(run))), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})


def learn_profiles(
    training: DataFrame, text_column: str = "text", lang_column: str = "lang", length: int = PROFILE
) -> Profiles:
    """Profiles from all rows of `training` with a text and a language."""
    ship(training.sparkSession)
    given = training.select(
        F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    counts = (
        given.mapInPandas(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    lists: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(lists, length)


def language_of(text: Column, profiles: Profiles) -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [profiles.classify(t) for t in texts], columns=["lang_pred", "score"]
            )

    return classify(text)


def identify(
    docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    found = language_of(F.col(text_column).cast("string"), profiles)
    return docs.select(F.col(id_column).alias("doc_id"), found.alias("_found")).select(
        "doc_id", "_found.lang_pred", "_found.score"
    )


def accepted(docs: DataFrame, profiles: Profiles, text_column: str = "text") -> DataFrame:
    """The rows of docs in a language that was learned, with all their columns."""
    given = docs.select(whole_rows(docs), F.col(text_column).cast("string").alias("text"))
    found = given.select("row", language_of(F.col("text"), profiles).alias("found"))
    return found.where(F.col("found.lang_pred") != UNKNOWN).select("row.*")
