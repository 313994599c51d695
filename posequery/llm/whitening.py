"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become integers first, so sums and scatter are exact at any size.  Tasks centre their
vectors at the rounded mean before multiplying and pass on partial sums, one row for each pair of
dimensions; what rounding the mean left is taken off exactly.  The scatter, a number per pair of
dimensions whatever the table's size, is factored on the driver: pivoted Cholesky gives a tall
triangular factor, and rotations of pairs of its columns make them orthogonal.  The columns'
norms then are the roots of the eigenvalues, the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequery.llm.common import record
from posequery.session import cut

SCALE, SHIFT = 1024, 100_000
#: Rows that are multiplied at a time; products of 20-bit numbers over so many stay exact in doubles.
_ROWS = 4096
_LONG = 2**63
#: Entries of this size or more have no place in a long with room to centre them.
_TOO_LARGE = float(2**51)
#: Sums travel as two decimals, since one would hold products of long numbers only a few times.
_LIMB = 10**30


@dataclass(frozen=True)
class Whitening:
    """``components`` (rows, unit length) with ``eigenvalues``; ``n``, ``sums`` and ``trace`` of the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``g`` with ``g @ g.T`` equal to ``matrix``: as many columns as its rank, lower triangular by pivots."""
    left, d = matrix.astype(np.float64).copy(), len(matrix)
    out = np.zeros((d, d))
    least = d * np.finfo(np.float64).eps * max(float(np.diag(left).max(initial=0.0)), 0.0)
    done = np.zeros(d, bool)
    for k in range(d):
        diagonal = np.where(done, -np.inf, np.diag(left))
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= least:
            return out[:, :k]
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        column[done] = 0.0
        out[:, k] = column
        left -= np.outer(column, column)
        done[pivot] = True
    return out


def one_sided_jacobi(factor: np.ndarray, most: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal, longest first.

    A sweep meets every pair once, in rounds of disjoint pairs that turn together.
    """
    g = factor.copy()
    r = g.shape[1]
    if r > 1:
        ring = np.arange(r + r % 2)  # an odd one out waits beside a number that is no column
        for _ in range(most):
            turned = False
            for _ in range(len(ring) - 1):
                a, b = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
                real = (a < r) & (b < r)
                turned |= _rotate(g, a[real], b[real])
                ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if not turned:
                break
    return g[:, np.argsort(-np.linalg.norm(g, axis=0), kind="stable")]


def _rotate(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    x, y = g[:, a], g[:, b]
    alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
    use = np.abs(gamma) > 1e-16 * np.sqrt(alpha * beta)
    if not use.any():
        return False
    zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=use)
    tangent = np.where(use, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
    cosine = 1 / np.sqrt(1 + tangent * tangent)
    sine = cosine * tangent
    g[:, a], g[:, b] = cosine * x - sine * y, sine * x + cosine * y
    return bool((np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)).any())


def _usable(vector: Column, d: int | None = None) -> Column:
    """Whether the vector is there, has ``d`` entries and only finite ones below ``_TOO_LARGE``."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _TOO_LARGE))
    size = F.size(vector) > 0 if d is None else F.size(vector) == d
    return F.coalesce(vector.isNotNull() & size & whole, F.lit(False))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """Entries as integers less ``SHIFT``, a row per vector."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _integers(part.column("vector"), d)


def _summed(rows: DataFrame, d: int, centre: np.ndarray | None) -> dict[tuple[int, int], int]:
    """Sums of ``x - centre`` (by ``(i, -1)``) or of products of two entries of it, over all rows, exact.

    ``(-1, -1)`` holds the number of rows.  Each task passes on one row for each sum.
    """
    pairs = [(-1, -1), *((i, -1) for i in range(d))] if centre is None else [(i, j) for i in range(d) for j in range(i, d)]
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.string()), ("low", pa.string())])

    def run(batches):
        total, rows_seen = np.zeros(d if centre is None else (d, d), object), 0
        for part, x in _parts(batches, d):
            rows_seen += part.num_rows
            if centre is None:
                total = total + x.astype(object).sum(0) if np.abs(x).max(initial=0) >= 2**50 else total + x.sum(0).astype(object)
                continue
            y = x - centre
            if np.abs(y).max(initial=0) >= 2**20:
                y = y.astype(object)
                total = total + y.T @ y
            else:
                y = y.astype(np.float64)
                total = total + (y.T @ y).astype(np.int64).astype(object)
        if rows_seen:
            values = [rows_seen, *total] if centre is None else [total[i, j] for i, j in pairs]
            limbs = [divmod(int(v), _LIMB) for v in values]
            yield record(schema, [[i for i, _ in pairs], [j for _, j in pairs], [str(h) for h, _ in limbs], [str(l) for _, l in limbs]])

    partial = rows.select("vector").mapInArrow(run, "i int, j int, high string, low string")
    summed = partial.groupBy("i", "j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("high", "low")))
    return {(r["i"], r["j"]): int(r["high"]) * _LIMB + int(r["low"]) for r in summed.collect()}  # a row for each pair of dimensions


def dimension(rows: DataFrame) -> int:
    """The most frequent length of the usable vectors, the greater of equally frequent ones; 0 without rows."""
    first = rows.where(_usable(F.col("vector"))).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def fit(rows: DataFrame, most: int = 8) -> Whitening:
    """Up to ``most`` components of the usable vectors of ``rows`` (a column ``vector``).

    Components without variance are left out; each has its largest entry positive.
    """
    d = dimension(rows)
    usable = rows.where(_usable(F.col("vector"), d))
    first = _summed(usable, d, None) if d else {}
    n = first.get((-1, -1), 0)
    if not n:
        return Whitening(0, [], np.zeros((0, d)), np.zeros(0), 0.0)
    plain = [first[i, -1] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in plain]
    products = _summed(usable, d, np.array(centre, np.int64))
    left = [s - n * c for s, c in zip(plain, centre)]
    scatter = np.zeros((d, d))
    for (i, j), value in products.items():
        scatter[i, j] = scatter[j, i] = (n * value - left[i] * left[j]) / (n * n)
    g = one_sided_jacobi(pivoted_cholesky(scatter))[:, :most]
    norms = np.linalg.norm(g, axis=0)
    components = (g / norms).T
    if len(components):
        peak = components[np.arange(len(components)), np.abs(components).argmax(1)]
        components = components * np.where(peak < 0, -1.0, 1.0)[:, None]
    return Whitening(n, [s + n * SHIFT for s in plain], components, norms**2, float(np.trace(scatter)))


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (``vec_id, vector``) as ``vec_id, deviation, whitened`` (an array), usable vectors only.

    ``deviation`` is null where it is too large for a long.
    """
    d, n = len(model.sums), model.n
    kind = rows.schema["vec_id"].dataType.simpleString()
    plain = [s - n * SHIFT for s in model.sums]
    centre = [(2 * s + n) // (2 * n) for s in plain] if n else []
    left = np.array([s - n * c for s, c in zip(plain, centre)], object)
    basis = model.components.T / np.sqrt(model.eigenvalues) if len(model.eigenvalues) else np.zeros((d, 0))

    def run(batches):
        for part, x in _parts(batches, d):
            y = x - np.array(centre, np.int64)
            whitened = (y.astype(np.float64) - (left / n).astype(np.float64)) @ basis
            reach = (int(np.abs(y).max(initial=0)) + 1) * n
            if reach * reach * d < _LONG:
                deviation = ((y * n - left.astype(np.int64)) ** 2).sum(1)
            else:
                exact = ((y.astype(object) * n - left) ** 2).sum(1)
                deviation = [int(v) if v < _LONG else None for v in exact]
            ids = part.column("vec_id")
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * basis.shape[1]), pa.array(whitened.reshape(-1)))
            schema = pa.schema([("vec_id", ids.type), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
            yield record(schema, [ids, deviation, flat])

    usable = rows.where(_usable(F.col("vector"), d)) if n else rows.where("false")
    return usable.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""
    if not n or not k:
        return 0.0
    w = F.col("whitened")
    means = projected.agg(*(F.sum(w[i]).alias(f"m{i}") for i in range(k))).first()
    off = [w[i] - F.lit(means[i] / n) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = projected.agg(*(F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(total / n - (i == j)) for total, (i, j) in zip(sums, pairs))


def whiten(docs: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    Every row counts for itself, repeated ones and null ids too.  Dropped are rows whose vector is
    null, empty, of another length than most vectors, or holds null or non-finite entries or those
    of 2**51 and more.
    Components without variance are left out, so equal vectors or a single one give no rows, as does
    an empty table.  Equal eigenvalues leave the choice of their components open, but all
    rows have the same.  Runs jobs when called.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    model = fit(rows, most)
    k = len(model.eigenvalues)
    projected = cut(project(rows, model), "whitened")
    error = identity_error(projected, model.n, k)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    turned = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return turned.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
