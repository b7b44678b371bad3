"""Whitened embeddings from a compensated covariance and a divide-and-conquer eigen-solve.

The covariance is summed over the distinct vectors in double-double: vectors are
centred on a mean that is itself high and low part, centred entries are split
into slices of a few bits, so that the outer products of a block of rows add up
without any rounding in one matrix product, and the exact products are added to
a high and a low part by error-free sums. Tasks return both parts, which are
merged by the same sums. The matrix, as wide as a vector, is made tridiagonal by
reflections; the eigen-solve halves it, solves the halves and joins them by the
roots of the secular equation.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Fixed values of the integer form x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of one block, bits of one slice: 2 * SLICE_BITS + log2(BLOCK) <= 53, so that sums of products are exact.
BLOCK, SLICE_BITS, SLICES = 1024, 21, 3
#: Tasks that merge the sums of all others.
MERGERS = 32
#: Entries beyond this have no exact integer form.
LARGEST = float(1 << 46)
#: An eigenvalue below this share of the largest is known to fewer than four digits in double precision: its component has no scale and is not returned.
RANK_SHARE = 1e-11
NOISE = 1e-32


# --- sums without rounding -------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_parts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-double arrays."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def in_parts(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


def outer_products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the rows of the outer products of ``high + low``, as high and low part.

    Each column is cut into slices at fixed binary places, so the products of
    slices are whole multiples of one unit and their sums fit 53 bits: the
    matrix product is exact in any order. What the slices leave is below
    2**-63 of a column's largest entry and enters in plain double precision.
    """
    top = np.abs(high).max(axis=0, initial=0)
    place = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) + 1)
    parts, rest = [], high
    for k in range(1, SLICES + 1):
        unit = place * 2.0 ** (53 - 1 - k * SLICE_BITS)
        part = (rest + unit) - unit
        parts.append(part)
        rest = rest - part
    rest = rest + low
    total = np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            if i + j < SLICES + 1:
                total = add_parts(total, (a.T @ b, 0.0))
    cross = high.T @ rest
    return add_parts(total, (cross + cross.T, 0.0))


# --- eigenvectors of a symmetric matrix ------------------------------------


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, neighbour diagonal and Q with a = Q T Q'."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        largest = np.abs(x).max()
        if largest == 0:
            continue
        x /= largest
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        x /= np.sqrt(x @ x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return a.diagonal().copy(), (a.diagonal(1) + a.diagonal(-1)) / 2, q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (d - x)) for rising, distinct d and rho > 0: (d - x in rows of roots, roots).

    A root lies between d[i] and the next one. It is kept as its distance from
    the nearer of the two, found by bisection, so that differences stay exact.
    """
    n = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    middle = d + gap / 2
    value = 1 + rho * (z**2 / (d[None] - middle[:, None])).sum(1)
    left = value >= 0
    left[-1] = True
    origin = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    apart = d[None] - d[origin][:, None]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    for _ in range(300):
        at = (low + high) / 2
        with np.errstate(divide="ignore"):
            above = 1 + rho * (z**2 / (apart - at[:, None])).sum(1) > 0
        moved = (at != low) & (at != high)
        if not moved.any():
            break
        high, low = np.where(above & moved, at, high), np.where(~above & moved, at, low)
    # The end that is not a pole.
    at = np.where(left, high, low)
    return apart - at[:, None], d[origin] + at


def _join(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho * z z'."""
    if rho < 0:
        values, vectors = _join(-d, z, -rho)
        return -values, vectors
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    turn = np.eye(n)
    # The matrix was scaled to a largest entry of 1: what is below NOISE in it is rounding, wherever it stands.
    small = max(NOISE, 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * (z @ z)))
    live: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) * np.sqrt(z @ z) <= small:
            continue
        if live and d[i] - d[live[-1]] <= small:
            # Two equal poles: turned into one that bears the weight of both and one without weight.
            j = live[-1]
            size = np.hypot(z[j], z[i])
            c, s = z[i] / size, z[j] / size
            turn[:, [j, i]] = np.stack((c * turn[:, j] - s * turn[:, i], s * turn[:, j] + c * turn[:, i]), axis=1)
            z[j], z[i] = 0.0, size
            d[j], d[i] = c * c * d[j] + s * s * d[i], s * s * d[j] + c * c * d[i]
            live[-1] = i
        else:
            live.append(i)
    values, vectors = d.copy(), np.eye(n)
    if live:
        pole = d[live]
        differences, roots = _secular(pole, z[live], rho)
        # The weights for which the roots are exact: eigenvectors from them are orthogonal.
        across = pole[:, None] - pole[None]
        np.fill_diagonal(across, 1.0)
        weight = np.abs(-differences.diagonal() * np.prod(np.where(np.eye(len(live), dtype=bool), 1.0, differences.T / across), axis=1))
        exact = np.copysign(np.sqrt(weight), z[live])
        found = exact[None] / differences
        found /= np.sqrt((found**2).sum(1))[:, None]
        values[live] = roots
        vectors[np.ix_(live, live)] = found.T
    out = np.empty((n, n))
    out[order] = turn @ vectors
    return values, out


def _halves(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(d) <= 1:
        return d.copy(), np.eye(len(d))
    m = len(d) // 2
    rho = e[m - 1]
    first, then = d[:m].copy(), d[m:].copy()
    first[-1] -= rho
    then[0] -= rho
    (a, p), (b, q) = _halves(first, e[: m - 1]), _halves(then, e[m:])
    values, vectors = _join(np.concatenate((a, b)), np.concatenate((p[-1], q[0])), rho)
    return values, np.concatenate((p @ vectors[:m], q @ vectors[m:]))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.abs(matrix).max(initial=0)
    if scale == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    d, e, q = _tridiagonal(matrix / scale)
    values, vectors = _halves(d, e)
    order = np.argsort(-values, kind="stable")
    vectors = (q @ vectors)[:, order]
    return values[order] * scale, vectors / np.sqrt((vectors**2).sum(0))


# --- the Spark jobs ---------------------------------------------------------


@dataclass
class Whitening:
    """What is fitted on the distinct vectors of one width."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centre(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n as high and low part."""
        mean = np.array([in_parts(Fraction(s, self.n)) for s in self.sums]).reshape(-1, 2)
        high, error = two_sum(x.astype(float), -mean[:, 0])
        return two_sum(high, error - mean[:, 1])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre(x)
        return high @ self.projection + low @ self.projection

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """Sum of (n*x - S)**2, in whole numbers: squares are added in three parts of 30 bits where a sum could pass 63."""
        if not len(x):
            return []
        most = self.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, self.sums), default=0)
        if most.bit_length() > 54:
            return [Decimal(sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True))) for row in x.tolist()]
        y = np.abs(self.n * x - np.array(self.sums, np.int64))
        a, b = y >> 27, y & ((1 << 27) - 1)
        parts = zip((a * a).sum(1).tolist(), (a * b).sum(1).tolist(), (b * b).sum(1).tolist(), strict=True)
        return [Decimal((p << 54) + (q << 28) + r) for p, q, r in parts]


def _integers(vector: Column) -> Column:
    """x of each entry; null where the vector is null or an entry is null, not finite or beyond LARGEST."""
    values = vector.cast("array<double>")
    fine = F.coalesce(F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)), F.lit(False))
    return F.when(fine, F.transform(values, lambda c: F.floor(c * SCALE) + SHIFT))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _merged(parts: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The sum of all rows (high, low) of double-double arrays as bytes: in MERGERS tasks, then of their sums."""

    def total(batches):
        held = None
        for batch in batches:
            for high, low in zip(batch.column(0), batch.column(1), strict=True):
                part = np.frombuffer(high.as_py()), np.frombuffer(low.as_py())
                held = part if held is None else add_parts(held, part)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], names=["high", "low"])

    rows = parts.repartition(MERGERS).mapInArrow(total, "high binary, low binary").collect()  # MERGERS rows at most
    return reduce(add_parts, [(np.frombuffer(r["high"]), np.frombuffer(r["low"])) for r in rows]) if rows else None


def _sum_of(fit: DataFrame, width: int, part) -> np.ndarray | None:
    """Sum over all rows of ``fit`` of what ``part`` (blocks of x -> high, low) gives, in double-double; the high part."""

    def run(batches):
        held = None
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for k in range(0, len(x), BLOCK):
                high, low = (a.ravel() for a in part(x[k : k + BLOCK]))
                held = (high, low) if held is None else add_parts(held, (high, low))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], names=["high", "low"])

    return _merged(fit.mapInArrow(run, "high binary, low binary"))


def _whole_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and exact sum of each dimension (decimals, summed before the shuffle)."""
    rows = fit.select(F.posexplode("x").alias("place", "entry")).groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("entry").cast("decimal(20,0)")).alias("s")).orderBy("place").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``distinct``, a table of different vectors ``x`` of ``width`` entries."""
    n, sums = _whole_sums(distinct)
    centred = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    high, low = _sum_of(distinct, width, lambda x: outer_products(*centred.centre(x)))
    covariance = ((high + low) / n).reshape(width, width)
    values, vectors = eigen((covariance + covariance.T) / 2)
    kept = min(components, int((values > RANK_SHARE * max(values[0], 0)).sum()))
    out = Whitening(n, sums, vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / max(np.trace(covariance), np.finfo(float).tiny), 0.0)
    if kept:
        high, low = _sum_of(distinct, width, lambda x: (lambda w: (w.sum(0), np.zeros(kept)))(out.whiten(x)))
        mean = (high + low) / n
        high, low = _sum_of(distinct, width, lambda x: (lambda w: outer_products(w, np.zeros_like(w)))(out.whiten(x) - mean))
        out.identity_error = float(np.abs(((high + low) / n).reshape(kept, kept) - np.eye(kept)).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component.

    Rows are left out whose vector is null or empty, or holds null or
    non-finite entries, or entries beyond LARGEST, which have no exact integer
    form. Vectors of different widths are fitted apart. Equal vectors count
    once in the fit and are all returned. Components without variance (rank,
    or a single vector) are not returned. A null vec_id stays null. deviation
    is decimal(38,0). An empty table gives no rows. Columns other than vec_id
    and embedding are not read.
    """
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _integers(F.col("embedding")).alias("x")).where("size(x) > 0"), "whitening-rows")
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("many")).select("x", F.size("x").alias("width")), "whitening-fit")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = [_of_width(rows, distinct, r["width"], components, schema) for r in distinct.groupBy("width").count().orderBy("width").collect()]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], schema)


def _of_width(rows: DataFrame, distinct: DataFrame, width: int, components: int, schema: str) -> DataFrame:
    model = fit(distinct.where(F.col("width") == width).select("x"), width, components)
    kept = len(model.explained)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            for k in range(0, len(x), BLOCK):
                part = x[k : k + BLOCK]
                m = len(part)
                ids = batch.column(0).slice(k, m).take(pa.array(np.repeat(np.arange(m), kept)))
                deviation = pa.array(model.deviations(part), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), kept)))
                rest = [model.whiten(part).ravel(), np.tile(model.explained, m), np.full(m * kept, model.identity_error)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, model.n)), deviation, *map(pa.array, rest)], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == width).mapInArrow(run, schema)
