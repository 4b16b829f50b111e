from collections import Counter

import pytest

from caregauge.llm import language

TRAINING = [
    ("en", "the cat and the dog are in the house with the other animals"),
    ("en", "this is the time of the year when the weather is good"),
    ("de", "der hund und die katze sind in dem haus mit den anderen tieren"),
    ("de", "das ist die zeit des jahres in der das wetter gut ist"),
    (None, "ignored ignored ignored"),
    ("fr", None),
]


def ngrams(text):
    """Plain version of the n-grams: letters in lower case, runs of others as one blank."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = f" {' '.join(kept.split())} "
    grams = Counter(c for c in kept if c != " ")
    for n in (2, 3):
        grams.update(kept[i : i + n] for i in range(len(kept) - n + 1))
    return grams


def ordered(grams, most):
    # Ties by key: longer n-grams have larger keys, then by their code points, a blank first.
    key = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return sorted(grams, key=lambda g: (-grams[g], key(g)))[:most]


def plain(text, training, most):
    profiles = {}
    for lang in sorted({x for x, t in training if x and t}):
        total = Counter()
        for x, t in training:
            if x == lang and t:
                total.update(ngrams(t))
        profiles[lang] = ordered(total, most)
    own = ordered(ngrams(text), most)
    apart = {
        lang: sum(abs(profile.index(g) - i) if g in profile else most for i, g in enumerate(own))
        for lang, profile in profiles.items()
    }
    best = min(apart, key=lambda x: (apart[x], x))
    return best, 1 - apart[best] / (len(own) * most)


@pytest.fixture(scope="module")
def training(spark):
    return spark.createDataFrame(TRAINING, "lang string, text string").repartition(4)


@pytest.mark.parametrize("most", [5, 40, 400])
def test_equals_plain_version(spark, training, most):
    profiles = language.learn_profiles(training, length=most)
    texts = ["The weather", "das Wetter!", "x", "Ein Hund und eine Katze.\n\n", "dog 12 Haus", "ñandú 漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.identify(df, profiles).collect():
        name, score = plain(texts[r.doc_id], TRAINING, most)
        assert (r.lang_pred, r.score) == (name, pytest.approx(score))


def test_texts_without_letters(spark, training, docs, nothing, nulls):
    profiles = language.learn_profiles(training)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 😀")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language.identify(df, profiles).collect()} == {("und", 0.0)}
    found = language.identify(docs, profiles)
    assert found.count() == docs.count() and found.where("score < 0 or score > 1").isEmpty()
    kept = language.accepted(docs, profiles)
    assert kept.columns == docs.columns
    assert kept.count() == found.where("lang_pred <> 'und'").count() < docs.count()
    assert language.identify(nothing, profiles).count() == 0 and language.accepted(nulls, profiles).count() == 0


def test_nothing_learned(nothing, docs):
    profiles = language.learn_profiles(nothing)
    assert language.identify(docs, profiles).where("lang_pred <> 'und'").isEmpty()


def test_held_out_accuracy(spark):
    from caregauge.llm.queries import language_id

    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = language_id(spark, folder).where("held_out").join(truth, "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.99 * found.count() > 0
