import hashlib
import random

import pytest

from caregauge.llm import centroids
from caregauge.llm.queries import centroid_clusters
from caregauge.llm.vectors import sums

CLASHING = ("x", "products", "cluster", "norm", "distance", "g", "a.b")
SCHEMA = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in CLASHING)
NAN, INF = float("nan"), float("inf")


def plain(rows, k, rounds, scale, dimensions, salt="3:"):
    """(id, cluster, distance) of the kept rows in order, and the centroids; whole distances in every round."""
    kept = []
    for i, vector in rows:
        if vector is not None and len(vector) == dimensions and all(c is not None and abs(c) < INF for c in vector):
            kept.append((i, tuple(int(c * scale // 1) for c in vector)))

    def key(r):
        return hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]

    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                centres[j] = [sum(p) // len(own) for p in zip(*own, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centres


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    # Multiples of 1/32 are exact as floats; few values make ties.
    made = [(i, [rng.randint(-40, 40) / 32 for _ in range(64)]) for i in range(150)]
    made += [(500 + i, made[7][1]) for i in range(60)]  # a third of copies
    made += [(None, made[3][1]), (3, made[3][1]), (None, [0.5] * 64), (900, [-0.0] * 64), (901, [0.0] * 64)]
    made += [(910, None), (911, []), (912, [1.0] * 63), (913, [1.0] * 65), (914, [1.0] * 63 + [None])]
    made += [(915, [1.0] * 63 + [NAN]), (916, [INF] + [1.0] * 63), (917, [1.0] * 63 + [-INF]), (None, None)]
    return made


def table(spark, rows):
    return spark.createDataFrame([(i, v, *CLASHING) for i, v in rows], SCHEMA).repartition(5)


def found(clusters):
    return [(r.vec_id, r.cluster, r.distance) for r in clusters.rows.collect()]



def order(triples):
    return sorted(triples, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2]))


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 1), (5, 0), (1, 2)])
def test_rows_equal_plain_version(spark, rows, k, rounds):
    made = centroids.clustered(centroids.integer_vectors(table(spark, rows)), k, rounds)
    expected, centres = plain(rows, k, rounds, 1024, 64)
    assert made.centroids == centres
    assert order(found(made)) == order(expected)


def test_query_adds_totals_and_digests(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroid_clusters(spark, str(tmp_path)).collect()
    expected, centres = plain(rows, 8, 10, 1024, 64)
    assert order([(r.vec_id, r.cluster, r.distance) for r in got]) == order(expected)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster)
        assert r.inertia == sum(d for *_, d in expected)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_products_are_updated_by_changes_alone(spark, rows):
    vectors = centroids.integer_vectors(table(spark, rows))
    old = centroids.first_centroids(vectors)
    new = [list(c) for c in old]
    new[2][5] += 3
    new[4][0] -= 7
    new[4][63] += 1
    steps = centroids.changes(old, new)
    assert [(list(p), list(s)) for p, s in steps if len(p)] == [([5], [3]), ([0, 63], [-7, 1])]
    start = centroids._with_products(vectors, old, centroids.changes([[0] * 64] * 8, old), True)
    for r in centroids._with_products(start, new, steps, False).collect():
        assert list(r.products) == [sum(a * b for a, b in zip(r.x, c, strict=True)) for c in new]
        assert r.norm == sum(a * a for a in r.x)


def test_fewer_vectors_than_centroids_and_none(spark, rows):
    few = rows[:3]
    made = centroids.clustered(centroids.integer_vectors(table(spark, few)))
    assert len(made.centroids) == 3 and order(found(made)) == order(plain(few, 8, 10, 1024, 64)[0])
    none = centroids.clustered(centroids.integer_vectors(table(spark, rows).where("false")))
    assert none.centroids == [] and found(none) == []
    assert [f.name for f in none.rows.schema] == ["vec_id", "x", "cluster", "distance"]


def test_empty_table_through_the_query(spark, rows, tmp_path):
    table(spark, [(1, None)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroid_clusters(spark, str(tmp_path)).collect() == []


def test_other_lengths_and_text_ids(spark):
    given = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.25, 1.0]), ("c", [4.0, 4.0])], "vec_id string, embedding array<double>")
    made = centroids.clustered(centroids.integer_vectors(given, 4, 2), 2, 5)
    rows = [(r.vec_id, list(r.embedding)) for r in given.collect()]
    assert order(found(made)) == order(plain(rows, 2, 5, 4, 2)[0])


def test_entries_too_large_are_an_error(spark):
    given = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(centroids.integer_vectors(given, 1024, 2))


def test_sums_send_a_row_per_task_and_place_at_most(spark):
    data = spark.range(10_000).selectExpr("array(cast(id % 7 as int), cast(-(id % 3) as int)) x", "cast(id % 3 as int) g").repartition(4)
    totals, counts = sums(data, 2, 3, "x", "g")
    ids = range(10_000)
    assert counts == [sum(i % 3 == g for i in ids) for g in range(3)]
    assert totals == [[sum(i % 7 for i in ids if i % 3 == g), sum(-(i % 3) for i in ids if i % 3 == g)] for g in range(3)]
