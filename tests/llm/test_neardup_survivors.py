"""Which rows stay where ids are missing or shared, and that both digests of a text agree."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from caregauge.llm import neardup

A = "a text about apples and pears and plums and nuts in late autumn or so"
NEAR_A = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39 40"


def test_texts_without_an_id_or_with_a_shared_one_stay(spark):
    rows = [
        (None, A), (None, "quite another text on boats and sails and harbours"), (None, "a third one with no near copy"),
        (None, f"{NEAR_A} 41"), (7, NEAR_A),  # near copies: that with the id stays
        (8, "two texts share this id but nothing else"), (8, "the other text has words of its own"), (8, "the other  text has words of its own"),
        (9, "same words and no id on the other row"), (None, "same words and no id on the other row"),
        (None, None), (None, " "), (4, ""), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = neardup.one_of_each_class(docs)
    kept = Counter((r.doc_id, " ".join((r.text or "").split())) for r in out.collect())
    assert out.columns == docs.columns
    assert kept == Counter(
        [
            (None, A), (None, rows[1][1]), (None, rows[2][1]), (7, NEAR_A), (8, rows[5][1]), (8, rows[6][1]), (9, rows[8][1]),
            (None, ""), (None, ""), (4, ""), (5, ""),
        ]
    )


def test_both_digests_agree_on_odd_endings(spark):
    ends = ["", " ", "\n", "\r\n", "\u0085", "\u2028", "\u2029", "\x0b", "\x1c", "\u00a0"]
    texts = [f"{a}one  two{b}{c}" for a in ends for b in ends for c in ends]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", neardup._digest(F.col("text")).alias("d"))
    wrong = [r.text for r in df.collect() if bytes(r.d) != hashlib.md5(neardup.normal_form(r.text)).digest()]
    assert not wrong
