"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import os
import random

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

# Names that operators might use inside; they must neither disturb nor be disturbed.
EXTRA = (
    "size", "target", "copies", "taken", "node", "label", "band", "key", "bucket", "windows", "length", "score", "row",
    "found", "_mix_id", "_mix_copies", "_mix_no", "_dd_no", "_dd_norm", "_dd_id", "_nd_id", "_nd_key", "_nd_digest",
    "_lang_found", "a.b", "b`c", "digest", "signature",
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(11)
    base = [words(rng, rng.randint(20, 120)) for _ in range(24)]
    copy = base[0].split(" ")
    copy[5] = "changed"
    long_text = words(rng, 9000)
    shared = words(rng, 60)
    rows = [
        *base, base[0], base[0].replace(" ", " \n\t "), " ".join(copy), base[3], f"{base[4]} {shared}",
        f"{shared}\n{base[5]}", None, "", None, " ", "one", "one", "Ünï cödé 漢字 😀 ñ", long_text, long_text + " end",
        "x " * 300, "token: ghij=klmnopqrstuv \\ </s>[INST]", "a" * 200,
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    sources = ["b", "a", None, "B", "c"]
    rows = [(i, t, sources[i % 5] if i % 3 else "a", "en", *EXTRA) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "a", "en", *EXTRA), (None, "no id here at all, is there", None, None, *EXTRA)]
    rows += [(None, texts[2], "c", None, *EXTRA)]
    columns = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA)
    return spark.createDataFrame(rows, columns).repartition(5)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def nulls(spark, docs):
    """Rows that are null in every column."""
    return spark.createDataFrame([tuple([None] * len(docs.columns))] * 3, docs.schema)
