"""Whitening of embeddings along their leading components, found by the Jacobi-Davidson method.

Entries become integers. The fit list holds each distinct vector once; its covariance is never formed. All that
the method asks of the data is the covariance times a few directions: tasks centre their vectors, multiply, and
send one sum per task. The driver holds a search space of a few directions and works on those alone:

1. Rayleigh-Ritz: the projected covariance gives the best approximate components in the search space.
2. A component whose residual |V u - e u| is at double precision is locked: it leaves the search, and everything
   later is orthogonal to it.
3. For the others the correction equation (I - Y Y')(V - e I)(I - Y Y') t = -r, Y being the locked and the
   approximate components, is solved by some steps of MINRES, all components in step, so that each inner step is
   one pass over the fit list. The corrections extend the search space, which shrinks to its best part when full.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; shorter vectors are
padded with zeros to the longest. Components without variance (fewer distinct vectors than components, or flat
ones) are left out, so that one distinct vector alone gives an empty result, as does an empty table. Repeated rows
count once in the fit and are all returned. Equal eigenvalues may be given in any rotation. Entries beyond 2^26
after scaling are an error, and so is a deviation beyond 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ship
from .vectors import complete, floored, lists, matrix, sums

COMPONENTS = 4
SCALE = 256
GUARD = 8  # directions sought beyond the wanted ones; they speed up the last of these
SPACE = 48  # directions in the search space before it shrinks
INNER = 6  # MINRES steps to a correction
INNER_GAIN = 0.1  # a correction is good enough when its equation's residual has shrunk to this
OUTER = 200
SEED = 13

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Components:
    """Number of fitted vectors, sums per dimension, and unit components (rows) by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(table: DataFrame, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x of the rows that are kept, and the length of x."""
    given = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("x")).where(complete(F.col("x")))
    width = given.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat(floored(F.col("x"), scale), F.array_repeat(F.lit(0), F.lit(width) - F.size("x")))
    return given.select("vec_id", padded.alias("x")), width


def _summed(frame: DataFrame, width: int, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all vectors of what `each` makes of a block of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += each(matrix(batch, "x", width))
        yield pa.RecordBatch.from_arrays([lists(total.reshape(1, -1), pa.float64())], ["part"])

    parts = frame.select("x").mapInArrow(add, "part array<double>").select(F.posexplode("part"))
    found = np.zeros(shape).reshape(-1)
    for r in parts.groupBy("pos").agg(F.sum("col").alias("total")).collect():
        found[r["pos"]] = r["total"]
    return found.reshape(shape)


def covariance_product(fit: DataFrame, mean: np.ndarray, n: int) -> Product:
    """A function that multiplies the covariance of the fit list with a block of directions, one pass each."""

    def product(block: np.ndarray) -> np.ndarray:
        def each(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(fit, len(mean), each, block.shape) / n

    return product


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The part of the block that is orthogonal to what is given and of full rank."""
    kept: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):  # repeated, as one pass leaves rounding errors of the parts it removes
            for other in against:
                column = column - other @ (other.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            if (left := np.linalg.norm(column)) < 1e-10:
                break
            column = column / left
        else:
            kept.append(column)
    return np.array(kept).T if kept else np.empty((len(block), 0))


def minres(operator: Product, right: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Approximate solutions of a symmetric system for each column of the right side, all in step."""
    beta = np.linalg.norm(right, axis=0)
    aim, eta = gain * beta, beta.copy()
    safe = np.where(beta > 0, beta, 1)
    old, v = np.zeros_like(right), right / safe
    solution, w_old, w = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        open_ = np.abs(eta) > aim
        if not open_.any():
            break
        p = operator(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * old
        next_beta = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        first = np.hypot(delta, next_beta)
        open_ &= first > 0
        first = np.where(first > 0, first, 1)
        second, third = s * alpha + c_old * c * beta, s_old * beta
        c_old, c, s_old, s = c, delta / first, s, next_beta / first
        w_old, w = w, (v - third * w_old - second * w) / first
        solution += np.where(open_, c * eta, 0) * w
        eta = -s * eta
        old, v = v, p / np.where(next_beta > 0, next_beta, 1)
        beta = next_beta
    return solution


def leading_components(product: Product, width: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric operator that is known by products."""
    wanted = min(wanted, width)
    block = min(wanted + GUARD, width)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((width, block)))
    image = product(space)
    locked, values = np.empty((width, 0)), np.empty(0)
    best, stale = np.inf, 0
    for _ in range(OUTER):
        inner = space.T @ image
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        approx, approx_image = space @ turn, image @ turn
        residual = approx_image - approx * ritz
        size = np.linalg.norm(residual, axis=0)
        scale = max(np.abs(ritz).max(initial=0), np.abs(values).max(initial=0))
        exact = len(locked.T) + len(space.T) == width  # the search space holds everything that is left
        enough = scale * width * np.finfo(float).eps
        open_count = wanted - len(values)
        # Rounding sets the level that residuals can reach; where they no longer shrink they have reached it.
        worst = size[:open_count].max()
        best, stale = (worst, 0) if worst < best / 2 else (best, stale + 1)
        settled = exact or (stale >= 4 and worst <= 1e-11 * scale)
        ready = 0
        while ready < open_count and (size[ready] <= enough or settled):
            ready += 1
        if ready:
            locked = np.concatenate([locked, _orthonormal(approx[:, :ready], locked)], 1)
            values = np.concatenate([values, ritz[:ready]])
            approx, approx_image, ritz, residual = (a[..., ready:] for a in (approx, approx_image, ritz, residual))
            best, stale = np.inf, 0
        # A later direction may prove larger than one that is locked; then it is wanted in its place.
        if len(values) >= wanted and not (len(ritz) and ritz[0] > values.min() + 1e-9 * scale):
            break
        if len(values) >= wanted:
            wanted = min(len(values) + 1, width)
        aimed = min(max(wanted - len(values), 1) + GUARD, len(ritz))
        known = np.concatenate([locked, approx[:, :aimed]], 1)
        levels = ritz[:aimed]

        def projected(t: np.ndarray, known=known, levels=levels) -> np.ndarray:
            moved = product(t) - t * levels
            return moved - known @ (known.T @ moved)

        right = -residual[:, :aimed]
        right -= known @ (known.T @ right)
        corrections = minres(projected, right, INNER, INNER_GAIN)
        if len(approx.T) + aimed > SPACE:
            keep = min(len(approx.T), 2 * block)
            approx, approx_image = approx[:, :keep], approx_image[:, :keep]
        added = _orthonormal(corrections, locked, approx)
        if not added.shape[1]:
            added = _orthonormal(np.random.default_rng(seed + 1).standard_normal((width, 1)), locked, approx)
        space = np.concatenate([approx, added], 1)
        image = np.concatenate([approx_image, product(added)], 1) if added.shape[1] else approx_image
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def fit_components(fit: DataFrame, width: int, wanted: int = COMPONENTS) -> Components | None:
    """Components of the distinct vectors x; None without vectors."""
    (total,), (n,) = sums(fit, width, 1) if width else ([[]], [0])
    if not n:
        return None
    mean = np.array([s / n for s in total])
    trace = float(_summed(fit, width, lambda x: ((x - mean) ** 2).sum(0), (width,)).sum()) / n
    if not trace:
        return Components(n, total, np.empty(0), np.empty((0, width)), 0.0)
    values, found = leading_components(covariance_product(fit, mean, n), width, wanted)
    spread = values > trace * width * np.finfo(float).eps
    return Components(n, total, values[spread][:wanted], found[:, spread].T[:wanted], trace)


def project(x: np.ndarray, fitted: Components) -> np.ndarray:
    """Whitened coordinates of a block of vectors, a row each."""
    return (x - fitted.mean) @ fitted.directions.T / np.sqrt(fitted.eigenvalues)


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact; an error where it passes 64 bits."""
    far = int(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)
    exact = np.int64 if far * far * max(len(total), 1) < 1 << 63 else object
    away = x.astype(exact) * n - np.array(total, exact)
    return (away * away).sum(1)


def identity_error(fit: DataFrame, fitted: Components) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k, width = fitted.directions.shape

    def mean_of(x: np.ndarray) -> np.ndarray:
        return project(x, fitted).sum(0)

    centre = _summed(fit, width, mean_of, (k,)) / fitted.n

    def products(x: np.ndarray) -> np.ndarray:
        w = project(x, fitted) - centre
        return w.T @ w

    return float(np.abs(_summed(fit, width, products, (k, k)) / fitted.n - np.eye(k)).max())


def whitened(table: DataFrame, wanted: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per kept row and component."""
    ship(table.sparkSession)
    rows, width = integer_vectors(table, scale, id_column, vector_column)
    # The covariance is over distinct vectors, read once per pass; equal ones meet before they are shuffled.
    fit = stage(rows.select("x").distinct())
    fitted = fit_components(fit, width, wanted)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if fitted is None or not len(fitted.eigenvalues):
        schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", width)
            away = pa.array(deviations(x, fitted.n, fitted.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), away, lists(project(x, fitted), pa.float64())], ["vec_id", "deviation", "at"]
            )

    placed = rows.mapInArrow(place, f"vec_id {kind}, deviation long, at array<double>")
    shares = F.array(*(F.lit(float(e) / fitted.trace) for e in fitted.eigenvalues))
    return placed.select("vec_id", "deviation", F.posexplode("at").alias("_place", "whitened")).select(
        "vec_id",
        (F.col("_place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
