import math
from fractions import Fraction

import numpy as np
import pytest

from railwatch.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int, component string, whitened int"
FOLDER = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y", 2) for i, v in rows], SCHEMA)


def whole(rows):
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    return [i for i, _ in fine], [[math.floor(64 * x) + 1_000_000 for x in v] + [1_000_000] * (width - len(v)) for _, v in fine]


def check(found, rows, components=32):
    """Hold every column against exact sums and numpy's eigenvalues."""
    ids, x = whole(rows)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = int((values > values[0] * 1e-9).sum())
    size = min(components, rank)
    assert len(found) == n * size and {r.n for r in found} == {n}
    explained = {r.component: r.explained for r in found}
    assert sorted(explained) == list(range(1, size + 1))
    np.testing.assert_allclose([explained[k + 1] for k in range(size)], values[:size] / np.trace(cov), rtol=1e-7)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    deviations = sorted((i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for i, r in zip(ids, x))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in found if r.component == 1)
    assert got == deviations
    return n, size, values, centred, ids


def by_row(found, size):
    """Matrix of whitened values for rows with unique ids, sorted by id."""
    table = {}
    for r in found:
        table.setdefault(r.vec_id, [0.0] * size)[r.component - 1] = r.whitened
    return np.array([table[i] for i in sorted(table)])


def test_equals_numpy_on_separated_directions(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (v * [9, 7, 5, 4, 3, 2.2, 1.5, 1]).tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    found = whitening.whiten(vectors(spark, rows).repartition(3)).collect()
    n, size, values, centred, ids = check(found, rows)
    _, basis = np.linalg.eigh(centred.T @ centred / n)
    want = (centred @ basis[:, ::-1] / np.sqrt(values))[np.argsort(ids)]
    got = by_row(found, size)
    signs = np.sign((want * got).sum(axis=0))
    np.testing.assert_allclose(got, want * signs, atol=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(100, None), (101, [None] * 5), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [])]
    rows += [(105, [1.0, 2.0]), (None, [1.0] * 5), (7, [3.0] * 5), (7, [3.0] * 5), (106, [0.0] * 5)]
    check(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_equal_eigenvalues_and_missing_directions(spark):
    # Corners of a cross: two equal eigenvalues, one lower, two directions without any spread.
    rows = [(k, v) for k, v in enumerate([[4, 0, 0, 1, 0], [-4, 0, 0, 1, 0], [0, 4, 0, 1, 0], [0, -4, 0, 1, 0], [0, 0, 1, 1, 0], [0, 0, -1, 1, 0]])]
    rows = [(k, [float(x) for x in v]) for k, v in rows]
    found = whitening.whiten(vectors(spark, rows)).collect()
    n, size, values, centred, _ = check(found, rows)
    assert size == 3
    got = by_row(found, size)
    np.testing.assert_allclose(got.T @ got / n, np.eye(3), atol=1e-12)


def test_nearly_equal_eigenvalues_keep_their_own_components(spark):
    # Two axes whose spreads differ in one row by one step: the components stay along the axes to double precision.
    rows = [(2 * k + s, [s_ * 10.0 if axis == 0 else 0.0, s_ * 10.0 if axis == 1 else 0.0]) for k in range(2) for s, (axis, s_) in enumerate([(k, 1), (k, -1)])]
    rows += [(90, [10.0 + 1 / 64, 0.0]), (91, [-10.0 - 1 / 64, 0.0]), (92, [0.0, 10.0]), (93, [0.0, -10.0])]
    fitted = whitening.fit(vectors(spark, rows))
    np.testing.assert_allclose(fitted.components, np.eye(2), atol=1e-15)
    assert fitted.eigenvalues[0] > fitted.eigenvalues[1]


def test_large_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * [1e9, 1e12, 1.0]).tolist()) for i in range(30)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.deviation for r in found} == {None} and found[0].identity_error < 1e-6
    assert len(found) == 90


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, []), (2, [])]])
def test_no_direction_gives_no_rows(spark, rows):
    found = whitening.whiten(vectors(spark, rows))
    assert found.collect() == [] and found.columns == [c.split()[0] for c in whitening.OUTPUT.split(", ")]


def determinant_polynomial(a):
    """Coefficients of det(x - a), the constant first, by Faddeev and LeVerrier in fractions."""
    n = len(a)
    m, out = [[Fraction(0)] * n for _ in range(n)], [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(a[i][h] * m[h][j] for h in range(n)) + (out[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        out.append(-sum(a[i][h] * m[h][i] for i in range(n) for h in range(n)) / k)
    return [int(c) for c in reversed(out)]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        rows = rng.integers(-10_000, 10_000, (n + 3 if n != 9 else 4, n)).astype(object)  # 9: of lower rank
        a = rows.T @ rows
        assert whitening.characteristic_polynomial(spark, a) == determinant_polynomial(a.tolist())


def test_hessenberg_with_zeros_on_the_way():
    a = np.array([[0, 0, 0, 2], [0, 0, 3, 0], [0, 3, 0, 0], [2, 0, 0, 5]])
    for p in (7, 101, 2_147_483_647):
        assert whitening.polynomial_modulo(a % p, p) == [c % p for c in determinant_polynomial(a.tolist())]


def test_primes_are_the_largest():
    def prime(n):
        return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))

    assert whitening.primes_below(1000, 200) == [n for n in range(999, 2, -1) if prime(n)]
    assert all(map(prime, whitening.primes_below(1 << 31, 3))) and whitening.primes_below(1 << 31, 1) == [2_147_483_647]


def test_roots_are_isolated_and_refined():
    true = [1, 2, 2, 3, 1000, 1001, 2**20]
    coefficients = [1]
    for r in true:
        coefficients = [a - r * b for a, b in zip([0, *coefficients], [*coefficients, 0])]
    roots = whitening.RealRoots(coefficients, 21)
    found = [roots.refined(r) for r in roots.isolated(7)]
    assert [r.count for r in found] == [1, 1, 1, 1, 2, 1]
    for root, want in zip(found, [2**20, 1001, 1000, 3, 2, 1]):
        low = Fraction(root.place << 21, 1 << root.bits)
        assert low < want <= low + Fraction(1 << 21, 1 << root.bits) and root.bits >= whitening.ROOT_BITS
    assert [r.count for r in roots.isolated(3)] == [1, 1, 1]


def test_products_are_exact():
    rng = np.random.default_rng(8)
    for most in (100, 1 << 25, 1 << 61):
        rows = rng.integers(-most, most, (5000 if most == 100 else 50, 3))
        assert (whitening.exact_products(rows) == rows.astype(object).T @ rows.astype(object)).all()


def test_query_on_all_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op13_embedding_whitening(spark, FOLDER).collect()
    n, size, values, centred, ids = check(found, rows)
    got = by_row(found, size)
    np.testing.assert_allclose(got.T @ got / n, np.eye(size), atol=1e-9)
    # Projections back into the space of the vectors keep the covariance of the first components.
    _, basis = np.linalg.eigh(centred.T @ centred / n)
    want = (centred @ basis[:, ::-1][:, :size] / np.sqrt(values[:size]))[np.argsort(ids)]
    overlap = want.T @ got / n
    np.testing.assert_allclose(np.abs(overlap), np.eye(size), atol=1e-6)
