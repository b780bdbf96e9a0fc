"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

1. Each entry c becomes y = floor(64 c); x = y + 1000000 has the same scatter. Tasks add up the products of [y, 1] exactly
   and Spark sums them as limbs of 30 bits, so the scatter C = n * sum(y y') - S S' is an exact integer matrix and
   V = C / n^2.
2. det(t I - C) modulo primes of 31 bits: reduction to Hessenberg form, then the recurrence of its leading minors. One
   task takes some primes; as many are taken as the bound (1 + trace / d)^d of all coefficients needs. Chinese
   remaindering gives the integer coefficients.
3. All roots are real, so the sign changes of p(t + a) count the roots above a exactly. Bisection with that count
   isolates the largest roots, on a grid of 2^-64; roots that one cell of the grid holds together are one repeated root.
   Signs of p at the middle narrow a single root down to its cell.
4. Each root's null space comes by inverse iteration in fixed-point integers of 192 fractional bits.

Only numbers of the size of the dimension reach the driver: d (d + 1) / 2 sums, d + 1 residues a prime, one vector a component.

Vectors that are null, hold null or non-finite entries, or are shorter than the longest (their last entries are missing) are
dropped. Rows that repeat an id, and rows without one, are rows of their own. No vectors left: no rows. Equal eigenvalues
share a space, of which any orthonormal basis serves. An eigenvalue of zero cannot be divided by: its component has whitened
null and explained 0 (null where nothing varies at all), and identity_error leaves it out. deviation is null where the exact
value passes a long; deviation_wide has it as a decimal, null beyond 38 digits. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
MOST_DIMS = 2048
LIMBS, LIMB_BITS = 6, 30
GRID = 64
FIXED = 192


@dataclass
class Whitening:
    """Components with their eigenvalues; vectors are the rows of ``axes``, of positive eigenvalues only."""

    n: int
    dims: int
    sums: list[int]
    values: list[float]
    explained: list[float | None]
    axes: np.ndarray


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have dims finite entries, and floor(64 c) of those rows, as doubles (exact)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(flat.reshape(len(at), dims) * SCALE)
    good = np.isfinite(y).all(axis=1)
    return at[good], y[good]


def _whole(y: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: int64 while they fit, Python's otherwise."""
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], dtype=object).reshape(y.shape)


def _products(column: str, dims: int) -> Callable:
    """Sums over a task of the products of [y, 1] with itself, as limbs."""
    upper = np.triu_indices(dims + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), dtype=object)
        for batch in batches:
            _, y = _vectors(batch.column(0), dims)
            small = not y.size or np.abs(y).max() < 2.0**20
            for k in range(0, len(y), 4096):
                block = np.hstack([y[k : k + 4096], np.ones((len(y[k : k + 4096]), 1))])
                if small:  # every sum is below 2^53
                    total += (block.T @ block).astype(np.int64).astype(object)
                else:
                    whole = _whole(block).astype(object)
                    total += whole.T @ whole
        value = total[upper]
        limbs = []
        for k in range(LIMBS):
            limbs.append(pa.array([int(v) for v in (value & ((1 << LIMB_BITS) - 1) if k < LIMBS - 1 else value)], pa.int64()))
            value = value >> LIMB_BITS
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *limbs], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    return run


def scatter(vectors: DataFrame, column: str, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums of y, and the exact scatter matrix n * sum(y y') - S S'."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = vectors.select(column).mapInArrow(_products(column, dims), "i long, j long, " + ", ".join(f"{x} long" for x in limbs))
    full = np.zeros((dims + 1, dims + 1), dtype=object)
    for row in parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs]).collect():
        full[row.i, row.j] = full[row.j, row.i] = sum(row[x] << (LIMB_BITS * k) for k, x in enumerate(limbs))
    n, sums = full[dims, dims], full[:dims, dims]
    return n, list(sums), n * full[:dims, :dims] - np.outer(sums, sums)


def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3,215,031,751."""
    if n < 11 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(product: int) -> list[int]:
    """Primes below 2^31, falling, whose product passes the given one."""
    found, have, p = [], 1, (1 << 31) - 1
    while have <= product:
        if is_prime(p):
            found.append(p)
            have *= p
        p -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - matrix) modulo p, that of the constant first."""
    h, d = np.array(matrix % p, dtype=np.int64), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :, k:] = (h[k + 2 :, k:] - f[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        weights, run = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            run = run * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k - 1]) * run % p
        minors[k] = (row - (weights[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> list[int]:
    """The integers of least absolute value with these residues."""
    values, have = [0] * len(residues[0]), 1
    for residue, p in zip(residues, moduli):
        inverse = pow(have, -1, p)
        values = [v + have * ((int(r) - v) * inverse % p) for v, r in zip(values, residue)]
        have *= p
    return [v - have if 2 * v > have else v for v in values]


def _dealt(spark: SparkSession, count: int, work: Callable[[int], bytes]) -> list[bytes]:
    """work(0) ... work(count - 1), run in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([work(k)], pa.binary())], ["k", "out"])

    if not count:
        return []
    rows = spark.range(0, count, 1, min(count, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "k long, out binary").collect()
    return [bytes(r.out) for r in sorted(rows)]


def polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(t I - matrix) of a positive semidefinite integer matrix, that of the constant first."""
    d, trace = len(matrix), int(np.trace(matrix))
    moduli = primes(2 * ((d + trace) // d + 1) ** d)
    found = _dealt(spark, len(moduli), lambda k: polynomial_mod(matrix, moduli[k]).tobytes())
    return remaindered([np.frombuffer(x, np.int64) for x in found], moduli)


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots (with multiplicity) are above a; exact where all roots are real."""
    c = list(coefficients)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += a * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolated(coefficients: list[int], top: int, most: int) -> list[tuple[int, int, int]]:
    """Cells (low, high, m), falling, of the largest ``most`` roots: low < roots <= high, m of them. m is above 1 only where
    the cell has width 1."""
    found: list[tuple[int, int, int]] = []
    stack = [(0, top, roots_above(coefficients, 0), 0)]
    while stack and sum(m for *_, m in found) < most:
        low, high, above_low, above_high = stack.pop()
        count = above_low - above_high
        if count and (count == 1 or high - low == 1):
            found.append((low, high, count))
        elif count:
            middle = (low + high) // 2
            at = roots_above(coefficients, middle)
            stack += [(low, middle, above_low, at), (middle, high, at, above_high)]
    return found


def narrowed(coefficients: list[int], low: int, high: int) -> tuple[int, int]:
    """A cell of width 1 of the single root in (low, high]."""

    def value(a: int) -> int:
        out = 0
        for c in reversed(coefficients):
            out = out * a + c
        return out

    end = value(high)
    while high - low > 1:
        middle = (low + high) // 2
        if end == 0 or (at := value(middle)) == 0:
            return (high - 1, high) if end == 0 else (middle - 1, middle)
        low, high = (low, middle) if (at > 0) == (end > 0) else (middle, high)
    return low, high


def null_space(matrix: np.ndarray, root: Fraction, m: int) -> np.ndarray:
    """m orthonormal rows that span the null space of matrix - root I, by inverse iteration in fixed point."""
    d = len(matrix)
    a = np.array([[int(v) << FIXED for v in row] for row in matrix], dtype=object).reshape(d, d)
    a[np.diag_indices(d)] -= (root.numerator << FIXED) // root.denominator
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << FIXED) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k : k + 1, k + 1 :]) >> FIXED
    rng = np.random.default_rng(d)
    vectors = rng.standard_normal((d, m))
    for _ in range(3):
        fixed = np.array([[int(v * 2.0**60) << (FIXED - 60) for v in row] for row in vectors], dtype=object).reshape(d, m)[order]
        for k in range(d):
            fixed[k + 1 :] -= (a[k + 1 :, k : k + 1] * fixed[k : k + 1]) >> FIXED
        for k in range(d - 1, -1, -1):
            fixed[k] = (fixed[k] << FIXED) // a[k, k]
            fixed[:k] -= (a[:k, k : k + 1] * fixed[k : k + 1]) >> FIXED
        largest = [max(map(abs, fixed[:, j])) or 1 for j in range(m)]
        vectors = np.linalg.qr(np.array([[float(Fraction(v, s)) for v, s in zip(row, largest)] for row in fixed]).reshape(d, m))[0]
    turned = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(m)])
    return np.ascontiguousarray((vectors * turned).T)


def components(spark: SparkSession, matrix: np.ndarray, most: int) -> list[tuple[Fraction, np.ndarray]]:
    """(eigenvalue, unit eigenvector) of the largest ``most`` positive eigenvalues of a positive semidefinite integer matrix."""
    shared = math.gcd(*map(int, matrix.ravel()))
    if not shared:
        return []
    small = matrix // shared
    exact = polynomial(spark, small)
    zero = next(k for k, c in enumerate(exact) if c)
    degree = len(exact) - 1 - zero
    scaled = [c << (GRID * (degree - k)) for k, c in enumerate(exact[zero:])]
    cells = isolated(scaled, (int(np.trace(small)) << GRID) + 1, min(most, degree))

    def work(k: int) -> bytes:
        low, high, m = cells[k]
        low, high = narrowed(scaled, low, high) if m == 1 else (low, high)
        vectors = null_space(small, Fraction(low + high, 2 << GRID), m)
        return (low + high).to_bytes(512, "little") + vectors.tobytes()

    found = []
    for out in _dealt(spark, len(cells), work):
        value = Fraction(int.from_bytes(out[:512], "little"), 2 << GRID) * shared
        found += [(value, v) for v in np.frombuffer(out[512:], np.float64).reshape(-1, len(matrix))]
    return found[:most]


def fit(vectors: DataFrame, column: str = "embedding", most: int = 32) -> Whitening | None:
    """The components of all vectors; None where there is no vector."""
    spark = vectors.sparkSession
    finite = F.forall("v", lambda e: e.isNotNull() & (F.abs(e * SCALE) < F.lit(float("inf"))))
    dims = vectors.select(F.col(column).cast("array<double>").alias("v")).where(finite).agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return None
    if dims > MOST_DIMS:
        raise ValueError(f"vectors have {dims} entries; at most {MOST_DIMS} are supported")
    n, sums, matrix = scatter(vectors, column, dims)
    found = components(spark, matrix, min(most, dims))
    trace = int(np.trace(matrix))
    missing = min(most, dims) - len(found)
    values = [float(value / n**2) for value, _ in found] + [0.0] * missing
    explained = [float(value / trace) for value, _ in found] + [0.0 if trace else None] * missing
    return Whitening(n, dims, sums, values, explained, np.array([v for _, v in found]).reshape(len(found), dims))


def _centred(model: Whitening, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """n y - S exactly, and its sum of squares."""
    wide = model.n * max(1.0, float(np.abs(y).max(initial=0))) >= 2.0**61 or max(map(abs, model.sums)) >= 1 << 61
    z = (_whole(y).astype(object) if wide else _whole(y)) * model.n - np.array(model.sums, dtype=object if wide else np.int64)
    largest = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))
    square = z if largest**2 * model.dims < 1 << 62 else z.astype(object)
    return z, [int(v) for v in (square * square).sum(axis=1)]


def _projected(model: Whitening, z: np.ndarray) -> np.ndarray:
    """Whitened values of the components with a positive eigenvalue."""
    k = len(model.axes)
    return (z.astype(np.float64) / model.n) @ model.axes.T / np.sqrt(np.array(model.values[:k]))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.axes)
    if not k:
        return None
    upper = np.triu_indices(k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            _, y = _vectors(batch.column(0), model.dims)
            block = np.hstack([_projected(model, _centred(model, y)[0]), np.ones((len(y), 1))])
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "v"])

    full = np.zeros((k + 1, k + 1))
    for i, j, v in vectors.select(column).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        full[i, j] = full[j, i] = v
    mean = full[:k, k] / model.n
    return float(np.abs(full[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, error: float | None, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per remaining vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                rows, y = _vectors(piece.column(1), model.dims)
                z, squares = _centred(model, y)
                white = np.full((len(rows), count), np.nan)
                white[:, : len(model.axes)] = _projected(model, z)
                flat = white.ravel()
                each = np.repeat(np.arange(len(rows)), count)
                long = pa.array([v if v < 1 << 63 else None for v in squares], pa.int64())
                wide = pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
                size = len(flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(size, model.n, np.int64)), long.take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)),
                        pa.array(model.explained * len(rows), pa.float64()), pa.array([error] * size, pa.float64()), wide.take(pa.array(each)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"],
                )

    return vectors.select(id_col, column).mapInArrow(run, schema)
