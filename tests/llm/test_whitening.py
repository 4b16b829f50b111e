import math
import random

import numpy as np
import pytest

from caregauge.llm import whitening
from caregauge.llm.queries import embedding_whitening

CLASHING = ("x", "at", "part", "pos", "component", "n", "whitened", "a.b")
SCHEMA = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in CLASHING)
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, *CLASHING) for i, v in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    spread = [0.6, 0.5, 0.45, 0.4, 0.38] + [0.2] * 19
    made = [(i, [rng.gauss(0.1, s) for s in spread]) for i in range(400)]
    made += [(1000 + i, made[7][1]) for i in range(200)]  # a third of copies
    made += [(7, made[7][1]), (None, made[9][1]), (None, [0.25] * 24), (950, [0.25] * 10), (951, [])]
    made += [(960, None), (961, [0.1] * 23 + [None]), (962, [NAN] + [0.1] * 23), (963, [INF] * 24), (None, None)]
    return made


def plain(rows, wanted=4, scale=256):
    """Kept ids and x, and the eigenvectors of the covariance of distinct x, all of it formed."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and abs(c) < INF for c in v)]
    width = max(len(v) for _, v in kept)
    single = [(i, [int(math.floor(float(np.float32(c)) * scale)) for c in v] + [0] * (width - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(x) for _, x in single}), float)
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return single, fit, values[::-1][:wanted], vectors[:, ::-1][:, :wanted]


def test_rows_equal_plain_version(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = embedding_whitening(spark, str(tmp_path)).collect()
    kept, fit, values, vectors = plain(rows)
    total = [int(s) for s in fit.sum(0)]
    n, trace = len(fit), ((fit - fit.mean(0)) ** 2).sum() / len(fit)
    found = {}
    for r in got:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-12)
        assert r.identity_error < 1e-10
        found.setdefault((r.vec_id, r.deviation, r.component), []).append(r.whitened)
    assert len(got) == 4 * len(kept)
    # A component may have either sign, the same for all rows.
    first = kept[0]
    own = (np.array(first[1]) - fit.mean(0)) @ vectors / np.sqrt(values)
    away = [sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for _, x in kept]
    signs = [math.copysign(1, own[c] * found[(first[0], away[0], c + 1)][0]) for c in range(4)]
    for (i, x), d in zip(kept, away, strict=True):
        expected = (np.array(x) - fit.mean(0)) @ vectors / np.sqrt(values) * signs
        for c in range(4):
            assert found[(i, d, c + 1)][0] == pytest.approx(expected[c], abs=1e-9)


def test_covariance_is_never_formed_yet_products_are_its(spark, rows):
    whitening.ship(spark)
    vectors, width = whitening.integer_vectors(table(spark, rows))
    fit = vectors.select("x").distinct()
    _, expected, _, _ = plain(rows)
    block = np.random.default_rng(1).standard_normal((width, 3))
    product = whitening.covariance_product(fit, expected.mean(0), len(expected))
    centred = expected - expected.mean(0)
    assert np.allclose(product(block), centred.T @ (centred @ block) / len(expected), rtol=1e-12, atol=1e-9)


def symmetric(values, seed):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return turn @ np.diag(values) @ turn.T


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 8.999, 8.998, 8.5] + [1.0] * 96,
        list(np.linspace(1, 2, 150)),
        [5.0, 5.0, 5.0, 5.0, 5.0, 1.0, 0.5] + [0.1] * 40,
        [3.0] * 30,
        [1e6, 1.0, 1e-3] + [1e-6] * 60,
        [2.0, 1.0],
        [4.0],
    ],
)
def test_leading_components_reach_double_precision(values):
    matrix = symmetric(values, 5)
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, vectors = whitening.leading_components(product, len(values), 4)
    expected = np.linalg.eigvalsh(matrix)[::-1][: min(4, len(values))]
    assert np.allclose(found[:4], expected, rtol=1e-12, atol=1e-12 * expected[0])
    vectors, found = vectors[:, : len(expected)], found[: len(expected)]
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-11 * expected[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(expected))).max() < 1e-12
    assert sum(calls) < 40 * len(values) + 2000


def test_minres_solves_indefinite_systems():
    matrix = symmetric([3.0, 2.0, 1.0, -1.0, -2.0, 0.5], 2)
    right = np.random.default_rng(3).standard_normal((6, 2))
    assert np.allclose(matrix @ whitening.minres(lambda b: matrix @ b, right, 12, 1e-13), right, atol=1e-9)


def test_too_little_to_whiten(spark, rows):
    def run(some):
        return whitening.whitened(table(spark, some)).collect()

    assert run([(1, None)]) == [] and run([(1, []), (2, [])]) == [] and run([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []
    assert whitening.whitened(table(spark, rows).where("false")).collect() == []
    # Three points on a line: one component has variance.
    line = run([(1, [0.0, 0.0, 0.0]), (2, [0.25, 0.5, 0.0]), (3, [0.5, 1.0, 0.0]), (3, [0.5, 1.0, 0.0])])
    assert sorted((r.vec_id, r.component) for r in line) == [(1, 1), (2, 1), (3, 1), (3, 1)]
    assert {round(r.explained, 12) for r in line} == {1.0}
    assert sorted(abs(round(r.whitened, 9)) for r in line) == [0.0] + [round(math.sqrt(1.5), 9)] * 3


def test_deviations_are_exact_and_never_wrap():
    x = np.array([[3, -4], [0, 1]])
    assert list(whitening.deviations(x, 10**6, [5, -7])) == [(3 * 10**6 - 5) ** 2 + (7 - 4 * 10**6) ** 2, 25 + (10**6 + 7) ** 2]
    huge = whitening.deviations(x, 10**12, [5, -7])
    assert huge[0] == (3 * 10**12 - 5) ** 2 + (7 - 4 * 10**12) ** 2
