from types import SimpleNamespace

import numpy as np
import pandas as pd

from railwatch.llm import ann, exact_search, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, length string, band int, share int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def usable(rows, zeros):
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, v) for i, v in fine if zeros or any(v)]


def brute(rows, every, top, change=lambda x: x):
    width = max(len(v) for _, v in rows)
    points = np.array([[change(x) for x in v] + [change(0.0) * 0] * (width - len(v)) for _, v in rows])
    ids, out = np.array([i for i, _ in rows]), {}
    for i in sorted({i for i in ids if i % every == 0}):
        query = min((list(p) for p, j in zip(points, ids) if j == i))
        scores = (points * np.array(query)).sum(axis=1)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != i][:top]
        out[int(i)] = [(int(ids[k]), scores[k]) for k in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def sample(n=400, width=8, copies=60):
    rng = np.random.default_rng(5)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(n, width)) * rng.lognormal(size=(n, 1)))]
    rows += [(n + i, [0.5] * width) for i in range(copies)]
    rows += [(1000, None), (1001, [None] * width), (1002, [float("nan")] * width), (1003, [float("inf")] + [0.0] * (width - 1))]
    rows += [(1020, [0.0] * width), (1005, [1.0, 2.0]), (1100, []), (None, [1.0] * width), (40, [9.0] * width)]
    return rows


def test_exact_search_equals_brute_force(spark, monkeypatch):
    rows = sample()
    expected = brute(usable(rows, True), 50, 5, lambda x: np.floor(256 * x))
    assert found(exact_search.top_products(vectors(spark, rows))) == expected
    for name, value in (("SEED_ROWS", 6), ("SHARE_ROWS", 32), ("BLOCK_QUERIES", 2), ("COORDINATE_COSINE", 0.0)):
        monkeypatch.setattr(exact_search, name, value)
    assert found(exact_search.top_products(vectors(spark, rows))) == expected


def test_pruning_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(6)
    for _ in range(200):
        points = np.floor(rng.normal(size=(50, 4)) * 50)
        query = np.floor(rng.normal(size=4) * 50)
        lengths = np.sqrt((points**2).sum(axis=1))
        units = points / np.where(lengths > 0, lengths, 1)[:, None]
        products = points @ query
        threshold = float(np.sort(products)[-3])
        kept = exact_search.candidates(query, float(np.sqrt(query @ query)), threshold, points, lengths, units)
        assert set(np.flatnonzero(products >= threshold)) <= set(kept)


def test_queries_of_a_block_are_scored_together(monkeypatch):
    rng, calls, real = np.random.default_rng(9), [], exact_search.products
    points = np.floor(rng.normal(size=(500, 16)) * 50)
    lengths = np.sqrt((points**2).sum(axis=1))
    entries = pd.DataFrame({"vec_id": np.arange(500), "v": list(points), "length": lengths})
    scores = points[:200] @ points.T
    np.fill_diagonal(scores, -np.inf)
    thresholds = -np.sort(-scores, axis=1)[:, 20]
    queries = pd.DataFrame({"query_id": np.arange(200), "v": list(points[:200]), "length": lengths[:200], "threshold": thresholds})
    monkeypatch.setattr(exact_search, "products", lambda a, b: calls.append(1) or real(a, b))
    monkeypatch.setattr(exact_search, "COORDINATE_COSINE", 2.0)
    got = exact_search._verified(SimpleNamespace(value=(16,)), 5)(entries, queries)
    order = [(q, int(i), int(scores[q, i])) for q in range(200) for i in np.lexsort((np.arange(500), -scores[q]))[:5]]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(order)
    assert len(calls) <= 5


def test_large_components(spark):
    rows = [(0, [2.0**100, 1.0]), (1, [2.0**100, 0.0]), (2, [-(2.0**100), 0.0]), (3, [2.0**30, 0.0])]
    got = found(exact_search.top_products(vectors(spark, rows)))
    assert got == {0: [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]}


def test_near_search_finds_most(spark):
    rows = sample()
    expected = brute(usable(rows, False), 20, 20)
    got = found(ann.nearest_neighbours(vectors(spark, rows)))
    assert got.keys() == expected.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    points = dict(usable(rows, False)[:400])
    for q, pairs in got.items():
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
        if q in points and q != 40:
            assert all(abs(s - np.dot(points[q], points[i])) < 1e-9 for i, s in pairs if i in points and i != 40)


def test_equal_vectors_come_in_the_order_of_ids(spark):
    rows = [(i, [0.1, 0.7, 0.3]) for i in range(200)]
    got = found(ann.nearest_neighbours(vectors(spark, rows)))
    assert all([i for i, _ in pairs] == [i for i in range(21) if i != q][:20] for q, pairs in got.items())
    exact = found(exact_search.top_products(vectors(spark, rows)))
    assert all([i for i, _ in pairs] == [i for i in range(6) if i != q][:5] for q, pairs in exact.items())


def test_small_shares_and_blocks(spark, monkeypatch):
    rows = sample(200)
    before = found(ann.nearest_neighbours(vectors(spark, rows)))
    monkeypatch.setattr(ann, "SHARE_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    assert found(ann.nearest_neighbours(vectors(spark, rows))) == before


def test_cells_are_visited_in_the_order_of_summed_distances():
    rng = np.random.default_rng(7)
    a, b, filled = rng.random(6), rng.random(5), rng.integers(0, 9, (6, 5))
    sums = a[:, None] + b
    for wanted in (1, 10, 50, 1000):
        seen = ann.Index._traversed(a, b, filled, wanted)
        assert sums[seen].max() <= sums[~seen].min() if (~seen).any() else True
        assert filled[seen].sum() >= min(wanted, filled.sum())


def test_no_vectors(spark):
    for rows in ([], [(1, None)]):
        assert ann.nearest_neighbours(vectors(spark, rows)).count() == 0
        assert exact_search.top_products(vectors(spark, rows)).count() == 0


def test_queries(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    exact = brute(usable(rows, True), 50, 5, lambda x: np.floor(256 * x))
    assert found(queries.op9_exact_top_k(spark, SMALL)) == exact
    near, got = brute(usable(rows, False), 20, 20), found(queries.op5_nearest_neighbours(spark, SMALL))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near[q]}) for q in near)
    assert hits >= 0.9 * sum(map(len, near.values()))
