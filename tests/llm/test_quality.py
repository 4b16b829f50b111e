import numpy as np
import pytest
from pyspark.sql import functions as F

from caregauge.llm import quality
from caregauge.llm.queries import quality_classifier


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(i % 251 for i in range(n))
        chunks = quality.chunks_of(data)
        starts = sorted({*range(0, max(n - quality.CHUNK, 0), quality.STRIDE), max(n - quality.CHUNK, 0)})
        assert len(chunks) == len(starts)
        seen = np.zeros(n, bool)
        for start, chunk in zip(starts, chunks, strict=True):
            part = data[start : start + quality.CHUNK + quality.WIDTH - 1]
            assert bytes(chunk[chunk < 256].astype(np.uint8)) == part
            seen[start : start + quality.CHUNK] = True
        assert seen.all()


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    texts = [quality.chunks_of(bytes(rng.integers(97, 123, n).astype(np.uint8))) for n in (30, 700, 1500)]
    sizes, labels = np.array([30.0, 700.0, 1500.0]), np.array([1.0, 0.0, 1.0])
    net = quality.Network(3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}

    def loss():
        firsts = np.cumsum([0, *(len(t) for t in texts)])[:-1]
        pooled = np.maximum(net.responses(np.concatenate(texts))[0], 0)
        p = net.forward(net.features(pooled, firsts, sizes))[1]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = quality._gradients(net, texts, sizes, labels)
    for name in ("filters", "bias", "dense", "out", "dense_bias", "out_bias"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        before = net.params[name][at]
        values = []
        for step in (1e-3, -1e-3):
            net.params[name][at] = before + step
            values.append(loss())
        net.params[name][at] = before
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(found[name][at], rel=0.05)


def test_scores_equal_a_plain_forward_pass():
    """Every response of every filter at every place, by loops."""
    rng = np.random.default_rng(4)
    net = quality.Network(5)
    net.params["bias"] = rng.normal(0, 0.2, quality.FILTERS).astype(np.float32)
    net.params["dense_bias"] = rng.normal(0, 0.2, quality.HIDDEN).astype(np.float32)
    p = {k: v.astype(float) for k, v in net.params.items()}
    texts = [b"", b"a", bytes(rng.integers(32, 127, 40).astype(np.uint8)), bytes(rng.integers(0, 256, 700).astype(np.uint8))]
    for text, score in zip(texts, net.score(texts), strict=True):
        starts = sorted({*range(0, max(len(text) - quality.CHUNK, 0), quality.STRIDE), max(len(text) - quality.CHUNK, 0)})
        pooled = []
        for start in starts:
            largest = [-np.inf] * quality.FILTERS
            for at in range(start, start + quality.CHUNK):
                # Beyond the text there is only padding, which no filter responds to.
                own = sum((p["filters"][k, text[at + k]] if at + k < len(text) else p["filters"][k, 256] for k in range(quality.WIDTH)))
                largest = np.maximum(largest, own)
            pooled.append(np.maximum(largest + p["bias"], 0))
        pooled = np.array(pooled)
        features = [*pooled.mean(0), *pooled.min(0), *pooled.max(0), np.log2(len(text) + 1) / 10]
        hidden = np.tanh(np.array(features) @ p["dense"] + p["dense_bias"])
        assert score == pytest.approx(1 / (1 + np.exp(-(hidden @ p["out"] + p["out_bias"][0]))), abs=1e-5)


def test_the_sample_is_bounded_in_bytes(spark):
    texts = spark.createDataFrame([(i, "x" * (100 if i % 2 else 5000)) for i in range(60)], "doc_id long, text string")
    labels = texts.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality.training_rows(texts, labels, sample=50, sample_bytes=20_000)
    assert 0 < sum(len(t) for t, _ in rows) <= 20_000 and len(rows) <= 50
    assert len(quality.training_rows(texts, labels, sample=50, sample_bytes=10**9)) == 50


def test_learns_and_scores_every_row(spark, docs, nothing, nulls):
    good = [(i, f"the quick brown fox {i} jumps over lazy dogs number {i * 7}") for i in range(120)]
    bad = [(1000 + i, f"BUY!! NOW!! {i} CHEAP!! BUY!! NOW!!") for i in range(120)]
    texts = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = texts.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    net = quality.train(texts.where("doc_id % 5 <> 0"), labels, sample=150)
    scored = texts.select("doc_id", quality.quality_of(F.col("text"), net).alias("score")).collect()
    assert all((r.score > 0.5) == (r.doc_id < 1000) for r in scored)
    again = quality.train(texts.where("doc_id % 5 <> 0").repartition(7), labels, sample=150)
    assert all((net.params[k] == again.params[k]).all() for k in net.params)
    scores = docs.select(quality.quality_of(F.col("text"), net).alias("score"))
    assert scores.count() == docs.count() and scores.where("score is null or score < 0 or score > 1").isEmpty()
    assert nothing.select(quality.quality_of(F.col("text"), net)).count() == 0
    assert nulls.select(quality.quality_of(F.col("text"), net).alias("s")).where("s is null").isEmpty()
    assert quality.train(texts, labels.where("false")) is None
    assert {r[0] for r in docs.select(quality.quality_of(F.col("text"), None)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_classifier(spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert (good.predicted == 1).mean() >= 0.97 and (bad.predicted == 0).mean() >= 0.7
