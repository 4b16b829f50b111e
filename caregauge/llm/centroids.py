"""Clustering around centroids with an incremental distance matrix, in exact integers.

Every vector becomes integers and keeps its dot product with each centroid in a written table. When a round
moves the centroids, a product changes by the vector's entries at the places where that centroid changed, times
those changes; nothing else is computed anew. The nearest centroid follows from the products alone, as
|x - c|^2 = |x|^2 - 2 x.c + |c|^2. Tables alternate between two folders, so that a round replaces the table of
two rounds before; a lost executor costs the tasks of one round. Tasks add up their vectors per centroid before
anything is shuffled, so that a cluster of any size is a few numbers. Only centroids reach the driver.

Defined results: rows whose vector is null, of another length, or holds null or non-finite entries are left out.
Centroids start as the vectors whose ids have the smallest sha256 (a null id counts as empty text; rows of one id
stand in the order of their vectors); with fewer vectors there are fewer centroids. Ties of distance go to the
smaller number; a centroid without vectors stays. Repeated rows are vectors of their own. An empty table gives an
empty result. Entries beyond 2^26 after scaling are an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import ship
from .vectors import complete, floored, lists, matrix, sums

CENTROIDS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SALT = "3:"


@dataclass
class Clusters:
    """rows: vec_id, x, cluster, distance (squared) of every vector; centroids by number."""

    rows: DataFrame
    centroids: list[list[int]]


def integer_vectors(
    table: DataFrame, scale: int = SCALE, dimensions: int = DIMENSIONS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id and x of the rows that are kept."""
    given = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("x"))
    kept = given.where((F.size("x") == dimensions) & complete(F.col("x")))
    return kept.select("vec_id", floored(F.col("x"), scale).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in vectors.select("x", order.alias("_order")).orderBy("_order", "x").limit(k).collect()]


def moved_centroids(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floored means of each centroid's vectors; one without vectors stays."""
    totals, counts = sums(state, len(centroids[0]), len(centroids), "x", "cluster")
    return [[t // n for t in total] if n else old for total, n, old in zip(totals, counts, centroids, strict=True)]


def changes(old: list[list[int]], new: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each centroid the places that change, and by how much."""
    steps = np.array(new, np.int64) - np.array(old, np.int64)
    return [(np.flatnonzero(step), step[step != 0]) for step in steps]


def _with_products(given: DataFrame, centroids: list[list[int]], steps: list[tuple[np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """The state with products brought up to date by the steps (from zero at first), and what follows from them."""
    k, width = len(centroids), len(centroids[0])
    norms = (np.array(centroids, np.int64) ** 2).sum(1)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", width)
            products = np.zeros((len(x), k), np.int64) if first else matrix(batch, "products", k).copy()
            for j, (places, step) in enumerate(steps):
                if len(places):
                    products[:, j] += x[:, places] @ step
            norm = (x**2).sum(1) if first else batch.column("norm").to_numpy()
            away = norms[None, :] - 2 * products
            cluster = away.argmin(1)  # the first of equals
            distance = norm + away[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    lists(x.astype(np.int32), pa.int32()),
                    pa.array(norm),
                    lists(products, pa.int64()),
                    pa.array(cluster.astype(np.int32)),
                    pa.array(distance),
                ],
                ["vec_id", "x", "norm", "products", "cluster", "distance"],
            )

    kind = given.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, x array<int>, norm long, products array<long>, cluster int, distance long"
    return given.mapInArrow(update, schema)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> Clusters:
    """Cluster vec_id and x (integers, all of one length). Stops early only where nothing would change any more."""
    spark = vectors.sparkSession
    ship(spark)
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        empty = vectors.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(empty.where("false"), [])
    folder = f"{scratch_folder(spark)}/clusters-{uuid4().hex}"

    def written(state: DataFrame, number: int) -> DataFrame:
        path = f"{folder}/{number % 2}"
        state.write.mode("overwrite").parquet(path)
        return spark.read.schema(state.schema).parquet(path)

    nowhere = [[0] * len(c) for c in centroids]
    state = written(_with_products(vectors, centroids, changes(nowhere, centroids), True), 0)
    for number in range(1, rounds + 1):
        new = moved_centroids(state, centroids)
        if new == centroids:
            break
        state = written(_with_products(state, new, changes(centroids, new), False), number)
        centroids = new
    return Clusters(state.select("vec_id", "x", "cluster", "distance"), centroids)
