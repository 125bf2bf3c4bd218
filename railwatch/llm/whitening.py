"""Embedding whitening from an exact characteristic polynomial.

Entries become integers, so n times the sum of squares and products minus the
product of sums, the scatter, is an integer matrix: n * n times the covariance.
Tasks sum it exactly and pass on 32-bit limbs, which Spark adds up.

The scatter's characteristic polynomial is found modulo many primes, each in a
task of its own by reduction to Hessenberg form, and put together by Chinese
remaindering. Its roots are real, so the sign changes among the coefficients of
p(x + a) count the roots above a exactly. Bisection by these counts isolates the
largest roots; interval refinement that doubles its bits brings each to 256.
Equal roots stay together in one interval.

A component is a vector of the null space of the scatter less its root: inverse
iteration in fixed point of 384 bits, again in a task per root, with as many
orthogonal vectors as the root has multiplicity. Neither eigenvalues nor
components depend on how close others lie.

What the driver holds grows with the square of the vectors' width, never with rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railwatch.llm.common import bounded_batches

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
# Roots to this many bits of the largest's bound; fixed point of components.
ROOT_BITS = 256
VECTOR_BITS = 384
LIMBS = 5

_EXACT_FLOAT = 2.0**53
_LARGEST = 2**62


class Whitening(NamedTuple):
    """A fitted model. Row k of ``components`` belongs to ``eigenvalues[k]`` of the covariance, largest first."""

    n: int
    sums: list[int]  # of floor(SCALE * entry), without the shift
    eigenvalues: np.ndarray
    explained: np.ndarray
    components: np.ndarray


# Integers from vectors


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of rows whose vector has neither null nor non-finite entries."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(v.isNotNull()).filter(F.coalesce(fine, F.lit(False)))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * entry) of a batch as a matrix of longs; missing entries are 0, beyond 62 bits values are cut."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(column.flatten().to_numpy() * SCALE), -_LARGEST, _LARGEST).astype(np.int64)
    return out


def exact_products(rows: np.ndarray) -> np.ndarray:
    """Sums of squares and products of columns as Python integers, from exact products of doubles.

    Rows are taken so few at a time that no sum leaves the whole numbers a double
    holds; entries too large for that are cut into limbs first.
    """
    width = rows.shape[1]
    total = np.zeros((width, width), object)
    most = int(np.abs(rows).max(initial=0))
    limbs = [rows] if most < 1 << 22 else [(rows >> 21 * k) & 0x1FFFFF if k < 2 else rows >> 42 for k in range(3)]
    largest = max(int(np.abs(x).max(initial=1)) for x in limbs) or 1
    step = max(1, int(_EXACT_FLOAT // largest**2))
    for at in range(0, len(rows), step):
        parts = [x[at : at + step].astype(np.float64) for x in limbs]
        for a, left in enumerate(parts):
            for b, right in enumerate(parts):
                product = (left.T @ right).astype(np.int64).astype(object)
                total += product << 21 * (a + b) if a + b else product
    return total


def _limbs(value: int) -> list[int]:
    """Base 2**32, the last limb signed."""
    return [(value >> 32 * k) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            rows = whole_numbers(batch.column("v"), width)
            total[1:, 1:] += exact_products(rows)
            total[0, 1:] += rows.astype(object).sum(axis=0) if len(rows) else 0
            total[0, 0] += len(rows)
        at = np.triu_indices(width + 1)
        limbs = np.array([_limbs(int(v)) for v in total[at]], np.int64)
        columns = [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), *(pa.array(limbs[:, k]) for k in range(LIMBS))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    return run


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, column sums, and sums of squares and products."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    partial = rows.select("v").mapInArrow(_sums(width), "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    total = np.zeros((width + 1, width + 1), object)
    for i, j, *parts in partial.groupBy("i", "j").agg(*(F.sum(c) for c in limbs)).collect():  # as many as the width squared
        total[i, j] = total[j, i] = sum(p << 32 * k for k, p in enumerate(parts))
    return total[0, 0], [int(s) for s in total[0, 1:]], total[1:, 1:]


# Characteristic polynomial


def primes_below(limit: int, count: int) -> list[int]:
    """The largest odd primes below ``limit``, by a sieve of stretches."""
    small = np.ones(math.isqrt(limit) + 2, bool)
    small[:2] = False
    for p in range(2, math.isqrt(len(small)) + 1):
        if small[p]:
            small[p * p :: p] = False
    found, high = [], limit
    while len(found) < count and high > 3:
        low = max(3, high - (1 << 16))
        alive = np.ones(high - low, bool)
        for p in np.flatnonzero(small).tolist():
            alive[max(p * p, -(-low // p) * p) - low :: p] = False
        found += (np.flatnonzero(alive)[::-1] + low).tolist()
        high = low
    return found[:count]


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo ``p`` with zeros below the first subdiagonal; ``p`` has at most 31 bits."""
    a = a.copy()
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        a[[k + 1, pivot]] = a[[pivot, k + 1]]
        a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(axis=1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo ``p``, the constant first."""
    h, n = hessenberg(a, p), len(a)
    leading = np.zeros((n + 1, n + 1), np.int64)  # row k: the polynomial of the leading k rows and columns
    leading[0, 0] = 1
    for k in range(1, n + 1):
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        leading[k, 1:] = leading[k - 1, :-1]
        leading[k] = (leading[k] - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[n].tolist()


def _residues(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [polynomial_modulo((shared.value % p).astype(np.int64), p) for p in batch["prime"].tolist()]
            yield pd.DataFrame({"prime": batch["prime"], "coefficients": found})

    return run


def combined(residues: dict[int, list[int]]) -> list[int]:
    """The integers of smallest size that have these residues."""
    value, modulus = np.zeros(len(next(iter(residues.values()))), object), 1
    for p, found in sorted(residues.items()):
        inverse = pow(modulus, -1, p)
        value = value + modulus * ((np.array(found, object) - value) * inverse % p)
        modulus *= p
    return [int(v) - modulus if v > modulus // 2 else int(v) for v in value]


def _tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of work, dealt over the cores."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(x - a) of a positive semidefinite integer matrix, the constant first."""
    # No coefficient exceeds the product of 1 + root, which is largest when all roots are equal.
    mean = 1 + -(-int(sum(a.diagonal())) // len(a))
    bits = len(a) * mean.bit_length() + 2
    primes = primes_below(1 << 31, bits // 30 + 1)
    shared = spark.sparkContext.broadcast(a)
    found = _tasks(spark, [(p,) for p in primes], "prime long").mapInPandas(_residues(shared), "prime long, coefficients array<long>")
    return combined({r.prime: list(r.coefficients) for r in found.collect()})  # bounded by the width


# Roots


class Root(NamedTuple):
    """A root of ``count`` multiplicity at most 2**-bits above place / 2**bits, in units of the bound."""

    place: int
    bits: int
    count: int


class RealRoots:
    """Roots of a polynomial with positive real roots only, all at most 2**log_bound."""

    def __init__(self, coefficients: list[int], log_bound: int):
        self.scaled = [c << log_bound * k for k, c in enumerate(coefficients)]
        self.degree = len(coefficients) - 1

    def _at(self, bits: int) -> list[int]:
        return [c << bits * (self.degree - k) for k, c in enumerate(self.scaled)]

    def above(self, place: int, bits: int) -> int:
        """How many roots lie above place / 2**bits: sign changes of the polynomial shifted there."""
        shifted = self._at(bits)
        for low in range(self.degree):
            for k in range(self.degree - 1, low - 1, -1):
                shifted[k] += place * shifted[k + 1]
        signs = [c > 0 for c in shifted if c]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def value(self, place: int, bits: int) -> int:
        total = 0
        for k in range(self.degree, -1, -1):
            total = total * place + (self.scaled[k] << bits * (self.degree - k))
        return total

    def isolated(self, wanted: int) -> list[Root]:
        """Intervals of the ``wanted`` largest roots, largest first, each with one root or with equal ones."""
        done, open_ = [], [(0, 0, self.degree, 0)]  # place, bits, roots above its lower edge, roots above its upper edge
        while open_:
            place, bits, over_low, over_high = open_.pop()
            count = over_low - over_high
            if not count or over_high >= wanted:
                continue
            if count == 1 or bits >= ROOT_BITS:
                done.append(Root(place, bits, count))
                continue
            middle = self.above(2 * place + 1, bits + 1)
            open_ += [(2 * place, bits + 1, over_low, middle), (2 * place + 1, bits + 1, middle, over_high)]
        return done

    def refined(self, root: Root) -> Root:
        """A single root to ROOT_BITS: guess its subinterval from the line between the ends, twice as many bits after each hit."""
        place, bits, _ = root
        if root.count > 1:
            return root
        step, low, high = 1, self.value(place, bits), self.value(place + 1, bits)
        while bits < ROOT_BITS:
            if high == 0:
                return Root(((place + 1) << (ROOT_BITS - bits)) - 1, ROOT_BITS, 1)
            step = min(step, ROOT_BITS - bits)
            fine = bits + step
            # A root on the lower edge belongs to the interval below; the sign just above it is the one that is not the upper edge's.
            positive = high < 0
            guess = (abs(low) << step) // (abs(low) + abs(high))
            a = (place << step) + min(guess, (1 << step) - 1)
            value_a, value_b = self.value(a, fine), self.value(a + 1, fine)
            starts = value_a == 0 and a == place << step or (value_a > 0) == positive and value_a != 0
            if starts and (value_b == 0 or (value_b > 0) != positive):
                place, bits, low, high, step = a, fine, value_a, value_b, 2 * step
            elif step > 1:
                step //= 2
            else:
                other = a ^ 1
                place, bits = other, fine
                low, high = self.value(other, fine), self.value(other + 1, fine)
        return Root(place, bits, 1)


# Components


def null_space(a: np.ndarray, log_bound: int, root: Root) -> np.ndarray:
    """Orthonormal rows that span the null space of ``a`` less a root, to double precision."""
    n, one = len(a), 1 << VECTOR_BITS
    shift = VECTOR_BITS - log_bound
    m = a * (1 << shift) if shift >= 0 else a >> -shift
    m = m.astype(object)
    m[np.diag_indices(n)] -= (2 * root.place + 1) << (VECTOR_BITS - root.bits - 1)
    order = list(range(n))
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(m[k:, k])))
        m[[k, pivot]] = m[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        if m[k, k] == 0:
            m[k, k] = 1
        if k + 1 < n:
            factor = m[k + 1 :, k] * one // m[k, k]
            m[k + 1 :, k + 1 :] -= factor[:, None] * m[k, k + 1 :] >> VECTOR_BITS
            m[k + 1 :, k] = factor

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(1, n):
            x[k] -= int((m[k, :k] * x[:k]).sum()) >> VECTOR_BITS
        for k in range(n - 1, -1, -1):
            rest = int((m[k, k + 1 :] * x[k + 1 :]).sum()) >> VECTOR_BITS
            x[k] = ((x[k] - rest) << VECTOR_BITS) // m[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        length = math.isqrt(int((x * x).sum())) or 1
        return x * one // length

    draw = np.random.default_rng(n)
    basis = [unit(np.array([int(v) for v in draw.integers(-(1 << 40), 1 << 40, n)], object)) for _ in range(root.count)]
    for _ in range(3):
        found: list[np.ndarray] = []
        for vector in basis:
            vector = unit(solved(vector))
            for _ in range(2):
                for other in found:
                    vector = vector - (int((vector * other).sum() >> VECTOR_BITS) * other >> VECTOR_BITS)
                vector = unit(vector)
            found.append(vector)
        basis = found
    rows = np.array([[math.ldexp(int(v >> VECTOR_BITS - 128), -128) for v in vector] for vector in basis])
    largest = np.abs(rows).argmax(axis=1)
    return rows * np.where(rows[np.arange(len(rows)), largest] < 0, -1.0, 1.0)[:, None]


def _vectors(shared, log_bound: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [null_space(shared.value, log_bound, Root(int(p), int(b), int(c))) for p, b, c in zip(batch["place"], batch["bits"], batch["count"])]
            yield pd.DataFrame({"at": batch["at"], "rows": [[r.tolist() for r in f] for f in found]})

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Mean, eigenvalues and components of all usable vectors; None where there is no vector or no entry."""
    spark = vectors.sparkSession
    rows = usable(bounded_batches(vectors))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return None
    n, sums, products = exact_sums(rows, width)
    scatter = n * products - np.array(sums, object)[:, None] * np.array(sums, object)
    trace = int(sum(scatter.diagonal()))
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros(0), np.zeros((0, width)))
    coefficients = characteristic_polynomial(spark, scatter)
    zeros = next(k for k, c in enumerate(coefficients) if c)
    log_bound = trace.bit_length()
    roots = RealRoots(coefficients[zeros:], log_bound)
    found = [roots.refined(r) for r in roots.isolated(min(components, width - zeros))]
    shared = spark.sparkContext.broadcast(scatter)
    work = _tasks(spark, [(k, str(r.place), r.bits, r.count) for k, r in enumerate(found)], "at int, place string, bits int, count int")
    solved = {r.at: r.rows for r in work.mapInPandas(_vectors(shared, log_bound), "at int, rows array<array<double>>").collect()}
    # Quotients of whole numbers are rounded once, whatever their size.
    values = [(((2 * r.place + 1) << log_bound), 1 << (r.bits + 1)) for r in found for _ in range(r.count)][:components]
    matrix = np.array([row for k in range(len(found)) for row in solved[k]])[:components]
    eigenvalues = np.array([a / (b * n * n) for a, b in values])
    return Whitening(n, sums, eigenvalues, np.array([a / (b * trace) for a, b in values]), matrix)


# Whitening


def whitened(rows: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Rows projected on the components, over the roots of the eigenvalues; and their exact deviations, None beyond a long."""
    largest = fitted.n * int(np.abs(rows).max(initial=0)) + max(map(abs, fitted.sums))
    kind = np.int64 if largest * largest * max(1, rows.shape[1]) < 2**63 else object
    apart = fitted.n * rows.astype(kind) - np.array(fitted.sums, kind)
    deviation = (apart * apart).sum(axis=1).tolist()
    centred = apart.astype(np.float64) / fitted.n if kind is np.int64 else (apart / fitted.n).astype(np.float64)
    scores = centred @ fitted.components.T / np.sqrt(fitted.eigenvalues)
    return scores, [d if d < 2**63 else None for d in deviation]


def _second_moments(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Whitening = shared.value
        size = len(fitted.eigenvalues)
        total = np.zeros((size + 1, size))
        for batch in batches:
            scores, _ = whitened(whole_numbers(batch.column("v"), len(fitted.sums)), fitted)
            total[:size] += scores.T @ scores
            total[size] += scores.sum(axis=0)
        i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def identity_error(rows: DataFrame, shared) -> float:
    """Largest entry, by size, of the covariance of the whitened rows less the identity."""
    fitted: Whitening = shared.value
    size = len(fitted.eigenvalues)
    summed = rows.select("v").mapInArrow(_second_moments(shared), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((size + 1, size))
    for r in summed.collect():  # 33 rows and 32 columns at most
        total[r.i, r.j] = r.total
    mean = total[size] / fitted.n
    return float(np.abs(total[:size] / fitted.n - np.outer(mean, mean) - np.eye(size)).max())


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _applied(shared, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Whitening = shared.value
        size = len(fitted.eigenvalues)
        for batch in batches:
            scores, deviation = whitened(whole_numbers(batch.column("v"), len(fitted.sums)), fitted)
            every = np.repeat(np.arange(len(batch)), size)
            columns = [
                batch.column("vec_id").take(pa.array(every)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(batch))),
                pa.array(np.full(len(every), fitted.n)),
                pa.array(deviation, pa.int64()).take(pa.array(every)),
                pa.array(scores.ravel()),
                pa.array(np.tile(fitted.explained, len(batch))),
                pa.array(np.full(len(every), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUTPUT.split(", ")])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, with the model's figures beside it.

    All usable vectors are fitted. Null vectors and vectors with null or non-finite
    entries are left out. Entries that shorter vectors lack count as 0, entries
    beyond 2**62 / 64 as that; the widest vector sets the size of the model. A
    component needs an eigenvalue above 0, so there are as many as the data have
    directions, and none (an empty table) for a single vector, equal vectors or an
    empty table. Equal eigenvalues share an orthonormal basis in fixed order. A
    deviation beyond a long is null. Null and repeated ids and repeated rows are
    rows each. Other columns are ignored.
    """
    spark = vectors.sparkSession
    fitted = fit(vectors, components)
    if fitted is None or not len(fitted.eigenvalues):
        return spark.createDataFrame([], OUTPUT)
    rows = usable(vectors)
    shared = spark.sparkContext.broadcast(fitted)
    return rows.mapInArrow(_applied(shared, identity_error(rows, shared)), OUTPUT)
