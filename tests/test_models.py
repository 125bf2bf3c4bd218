import numpy as np
import pytest
from pyspark.sql import functions as F

from flat_clusters import flat_clusters
from railwatch.functions.components import roots
from railwatch.operators import density, forest, hierarchy, neighbours, scoring, vectors
from railwatch.session import stored

VECTORS = "snapshot_id string, tenant_bank_id string, segment string, split string, x array<double>"


def frame(spark, points, tenant="T", split="train"):
    rows = [(f"{tenant}{i:04d}", tenant, "MERCHANT", split, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, VECTORS)


def forest_of(rows):
    models = forest.forest_models(forest.tree_samples(rows, trees=50))
    return forest.rescaled(forest.forest_scores(rows, models))


def test_forest_finds_injected_outliers(spark):
    random = np.random.default_rng(1)
    normal = np.c_[random.normal(30, 5, 90), random.normal(3000, 400, 90), random.random(90) * 0.1]
    odd = np.c_[random.normal(30, 5, 10), random.normal(90000, 9000, 10), 0.5 + random.random(10) * 0.4]
    rows = frame(spark, np.r_[normal, odd])
    scores = {r.snapshot_id: r.isolation_forest_score for r in forest_of(rows).collect()}
    assert min(scores.values()) == 0.0 and max(scores.values()) == 100.0 and len(set(scores.values())) == 100
    top = sorted(scores, key=scores.get)[-10:]
    assert sum(int(s[1:]) >= 90 for s in top) >= 9
    again = {r.snapshot_id: r.isolation_forest_score for r in forest_of(rows.repartition(7)).collect()}
    assert again == scores


def test_forest_keeps_tenants_apart_and_takes_lone_rows(spark):
    random = np.random.default_rng(2)
    one = frame(spark, random.normal(size=(40, 3)), "A")
    both = one.unionByName(frame(spark, random.normal(size=(1, 3)) + 100, "B", split="test"))
    alone = {r.snapshot_id: r.isolation_forest_score for r in forest_of(one).collect()}
    mixed = {r.snapshot_id: r.isolation_forest_score for r in forest_of(both).collect()}
    assert mixed.pop("B0000") == 0.0 and mixed == alone


def test_samples_are_bounded(spark):
    rows = spark.range(6000).selectExpr(
        "cast(id as string) snapshot_id", "'T' tenant_bank_id", "'MERCHANT' segment", "'train' split", "array(cast(id as double)) x"
    )
    sizes = [r["count"] for r in forest.tree_samples(rows, trees=4).groupBy("tree").count().collect()]
    assert sizes == [256] * 4


def test_upgraded_parties_are_refused(spark):
    rows = spark.createDataFrame([("T", "MERCHANT", "M", 30), ("T", "MERCHANT", "M", 20)], "tenant_bank_id string, segment string, party_id string, transaction_count long")
    with pytest.raises(forest.UpgradedTierError, match="M needs"):
        forest.check_tiers(rows)
    forest.check_tiers(rows.limit(1))


def brute(points, needed=5):
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(apart, axis=1)[:, min(needed, len(points)) - 1]
    reach = np.maximum(apart, np.maximum(core[:, None], core[None]))
    pairs = sorted((reach[i, j], i, j) for i in range(len(points)) for j in range(i))
    top, edges = list(range(len(points))), []
    for w, i, j in pairs:
        while top[i] != i:
            i = top[i]
        while top[j] != j:
            j = top[j]
        if i != j:
            top[i] = j
            edges.append((w, i, j))
    return core, edges


@pytest.mark.parametrize("block_rows", [2000, 25])
def test_distances_and_tree_equal_brute_force(spark, block_rows):
    random = np.random.default_rng(5)
    points = np.r_[random.normal(0, 1, (70, 3)), random.normal(9, 0.5, (60, 3)), random.uniform(-20, 20, (20, 3))]
    core, edges = brute(points)
    distinct = stored(density.distinct_points(frame(spark, points).drop("split")), "points")
    placed, pivots = density.placed_points(distinct, block_rows)
    cored = density.core_distances(placed, pivots)
    got = {r.point_id: r.core for r in cored.collect()}
    assert [got[f"T{i:04d}"] for i in range(150)] == pytest.approx(core.tolist())
    tree = density.spanning_edges(density.candidate_edges(cored, pivots), cored)
    weights = sorted(r.w for r in tree.collect())
    assert weights == pytest.approx(sorted(w for w, _, _ in edges))


@pytest.mark.parametrize("block_rows", [8000, 400])
def test_tree_of_clumps_equals_brute_force(spark, block_rows):
    """More than the neighbours of a point lie in its own clump, so the tree needs edges that no neighbour list holds."""
    random = np.random.default_rng(21)
    centres = random.uniform(-3, 3, (70, 4))
    points = (centres[:, None] + random.normal(0, 1e-9, (70, 30, 4))).reshape(-1, 4)
    points = np.r_[points, random.uniform(-4, 4, (40, 4)), [[90.0, 0, 0, 0]]]
    core, _ = brute(points)
    distinct = stored(density.distinct_points(frame(spark, points).drop("split")), "points")
    placed, boxes = density.placed_points(distinct, block_rows)
    assert boxes.count() == -(-len(points) // block_rows)
    cored = density.core_distances(placed, boxes)
    got = {r.point_id: r.core for r in cored.collect()}
    assert np.allclose([got[f"T{i:04d}"] for i in range(len(points))], core, rtol=1e-9, atol=0)
    edges = density.candidate_edges(cored, boxes).collect()
    tops = {name: name for name in got}
    for edge in edges:
        tops[_top(tops, edge.u)] = _top(tops, edge.v)
    assert len({_top(tops, name) for name in got}) == 1 and len(edges) == len(points) - 1
    assert np.allclose(sorted(r.w for r in edges), _tree_weights(points, core), rtol=1e-9, atol=0)


def _top(tops, name):
    while tops[name] != name:
        name = tops[name]
    return name


def _tree_weights(points, core):
    """Weights of the spanning tree, by adding the nearest point each time."""
    best, done, weights = np.full(len(points), np.inf), np.zeros(len(points), bool), []
    at = 0
    for _ in range(len(points) - 1):
        done[at] = True
        apart = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        best = np.minimum(best, np.maximum(apart, np.maximum(core, core[at])))
        at = int(np.where(done, np.inf, best).argmin())
        weights.append(best[at])
    return sorted(weights)


def test_neighbours_are_found_without_comparing_all():
    random = np.random.default_rng(22)
    points = random.normal(size=(20_000, 3))
    held = neighbours.tree(points)
    looked_at = []
    inner = neighbours._within
    neighbours._within = lambda q, o, r: looked_at.append(len(q) * len(o)) or inner(q, o, r)
    try:
        i, j, d = neighbours.nearest(points, np.full(len(points), np.inf), points, np.arange(len(points)), 16)
    finally:
        neighbours._within = inner
    assert sum(looked_at) < len(points) ** 2 / 10 and len(held.starts) > 300
    some = random.integers(0, len(points), 50)
    expected = np.sort(np.sqrt(((points[some][:, None] - points[None]) ** 2).sum(-1)), axis=1)[:, :16]
    assert np.allclose(d.reshape(-1, 16)[some], expected) and (i == np.repeat(np.arange(len(points)), 16)).all()


def clusters(spark, points, **options):
    found = density.density_clusters(frame(spark, points).drop("split"), **options)
    return {r.snapshot_id: r.cluster_id for r in found.collect()}


def partition(labels):
    groups = {}
    for key, label in labels.items():
        groups.setdefault(label, set()).add(key)
    return groups.pop(-1, set()), {frozenset(g) for g in groups.values()}


def test_two_groups_separate_whatever_the_blocks(spark):
    random = np.random.default_rng(6)
    points = np.r_[random.normal(0, 0.3, (40, 2)), random.normal(6, 0.3, (40, 2)), [[30, 30]]]
    noise, groups = partition(clusters(spark, points))
    assert len(groups) == 2 and "T0080" in noise
    assert all(len({int(k[1:]) // 40 for k in g}) == 1 for g in groups)
    assert partition(clusters(spark, points, block_rows=15)) == (noise, groups)


def spanning_tree(points, copies):
    """Core distances of weighted points and the edges of their tree, by comparing all."""
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    order = np.argsort(apart, axis=1)
    reached = np.cumsum(copies[order], axis=1) >= min(5, copies.sum())
    core = np.take_along_axis(apart, order, axis=1)[np.arange(len(points)), reached.argmax(axis=1)]
    reach = np.maximum(apart, np.maximum(core[:, None], core[None]))
    top, edges = list(range(len(points))), []
    for w, i, j in sorted((reach[i, j], i, j) for i in range(len(points)) for j in range(i)):
        a, b = i, j
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        if a != b:
            top[a] = b
            edges.append((w, i, j))
    return core, edges


@pytest.mark.parametrize("seed", [11, 12])
def test_tree_is_cut_alike_in_blocks_of_any_size(spark, seed):
    random = np.random.default_rng(seed)
    centres = random.uniform(-8, 8, (6, 2))
    points = np.concatenate([*(random.normal(c, 0.1 + 0.4 * i, (14, 2)) for i, c in enumerate(centres)), random.uniform(-12, 12, (12, 2))])
    copies = np.where(np.arange(len(points)) % 17 == 0, 6, 1)
    core, edges = spanning_tree(points, copies)
    # Equal edges may be added in any order, so they are told apart here.
    edges = [(w + n * 1e-7, i, j) for n, (w, i, j) in enumerate(edges)]
    plain = flat_clusters(
        np.array([i for _, i, _ in edges]), np.array([j for _, _, j in edges]), np.array([w for w, _, _ in edges]), copies, core, 5
    )
    expected = partition({f"T{i:04d}": int(c) for i, c in enumerate(plain)})
    tree = spark.createDataFrame([("B", "S", f"T{i:04d}", f"T{j:04d}", float(w)) for w, i, j in edges], "tenant_bank_id string, segment string, u string, v string, w double")
    rows = [("B", "S", f"T{i:04d}", int(copies[i]), float(core[i]), 5) for i in range(len(points))]
    table = spark.createDataFrame(rows, "tenant_bank_id string, segment string, point_id string, weight long, core double, needed int")
    for block in (1000, 40, 13):
        got = {r.point_id: r.cluster_id for r in hierarchy.flat_clusters(tree, table, block).collect()}
        assert partition(got) == expected
        assert set(got.values()) - {-1} == set(range(len(expected[1])))
    assert len(expected[1]) > 2


def test_upgraded_parties_are_refused_or_scored(spark):
    columns = "snapshot_id string, tenant_bank_id string, segment string, party_id string, split string, transaction_count long"
    schema = ", ".join([columns, *(f"{f} double" for f in vectors.FOREST_FEATURES if f != "transaction_count")])
    values = [None] * (len(vectors.FOREST_FEATURES) - 1)
    table = spark.createDataFrame([(f"s{i}", "T", "S", f"p{i % 3}", "train", 30 * (i % 3), *values) for i in range(9)], schema)
    assert {(r.party_id, r.tier) for r in forest.upgraded_parties(table).collect()} == {("p1", "ENTITY_SPECIFIC"), ("p2", "ENTITY_SPECIFIC")}
    with pytest.raises(forest.UpgradedTierError):
        forest.segment_scores(table)
    with pytest.raises(ValueError):
        forest.segment_scores(table, on_upgraded_tier="ignore")
    assert forest.segment_scores(table, on_upgraded_tier="baseline").count() == 9


def test_components_of_links(spark):
    links = spark.createDataFrame([("a", i, i + 1) for i in range(30)] + [("b", 3, 2), ("b", 7, 7)], "g string, node long, to long")
    got = {(r.g, r.node): r.root for r in roots(links, ["g"]).collect()}
    assert got == {**{("a", i): 0 for i in range(1, 31)}, ("b", 3): 2}


def test_a_lone_row_is_noise(spark):
    assert clusters(spark, np.zeros((1, 2))) == {"T0000": -1}
    assert set(clusters(spark, np.zeros((3, 2))).values()) == {-1}


def test_copies_form_a_cluster_of_their_own(spark):
    random = np.random.default_rng(8)
    points = np.r_[np.tile([[5.0, 5.0]], (40, 1)), random.normal(0, 0.3, (40, 2))]
    labels = clusters(spark, points)
    assert len({labels[f"T{i:04d}"] for i in range(40)}) == 1 and labels["T0000"] != -1


def test_weighted_leaves_equal_expanded_ones():
    random = np.random.default_rng(9)
    base = np.r_[random.normal(0, 0.4, (25, 2)), random.normal(5, 0.4, (25, 2))]
    copies = np.where(np.arange(50) % 7 == 0, 3, 1)
    expanded = np.repeat(base, copies, axis=0)
    core, edges = brute(expanded)
    whole = flat_clusters(
        np.array([i for _, i, _ in edges]), np.array([j for _, _, j in edges]), np.array([w for w, _, _ in edges]),
        np.ones(len(expanded), int), core, 5,
    )
    first = np.r_[0, np.cumsum(copies)[:-1]]
    apart = np.sqrt(((base[:, None] - base[None]) ** 2).sum(-1))
    reach = np.maximum(apart, np.maximum(core[first][:, None], core[first][None]))
    pairs, top, kept = sorted((reach[i, j], i, j) for i in range(50) for j in range(i)), list(range(50)), []
    for w, i, j in pairs:
        a, b = i, j
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        if a != b:
            top[a] = b
            kept.append((w, i, j))
    folded = flat_clusters(
        np.array([i for _, i, _ in kept]), np.array([j for _, _, j in kept]), np.array([w for w, _, _ in kept]), copies, core[first], 5
    )
    assert (np.repeat(folded, copies) == -1).tolist() == (whole == -1).tolist()
    pairs = {(a, b) for a, b in zip(np.repeat(folded, copies), whole)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_cluster_change(spark):
    rows = [("a", w, c, "WEEKLY") for w, c in enumerate((0, 0, 1, -1))] + [("b", 0, 0, "TO_DATE")]
    table = spark.createDataFrame(rows, "party_id string, window_start int, cluster_id int, window_type string").withColumn("tenant_bank_id", F.lit("T"))
    changed = density.with_cluster_change(table).orderBy("party_id", "window_start").collect()
    assert [r.cluster_changed for r in changed] == [None, False, True, True, None]


def test_projection_keeps_the_leading_variance(spark):
    random = np.random.default_rng(10)
    base = random.normal(size=200)
    points = np.c_[base, base * 2 + random.normal(0, 0.05, 200), random.normal(size=200)]
    scaled = vectors.standardised(frame(spark, points), 3)
    x = np.array([r.x for r in scaled.orderBy("snapshot_id").collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)
    projected = np.array([r.x for r in vectors.projected(scaled, 3).orderBy("snapshot_id").collect()])
    values = np.sort(np.linalg.eigvalsh(x.T @ x))[::-1]
    assert projected.shape == (200, 2)
    assert np.allclose((projected**2).sum(0), values[:2])


def test_imputation(spark):
    columns = ["snapshot_id string", "tenant_bank_id string", "segment string", "split string"]
    schema = ", ".join(columns + [f"{f} double" for f in vectors.FOREST_FEATURES])
    row = lambda i, split, v: (f"s{i}", "T", "MERCHANT", split, v, *([None] * 12))
    table = spark.createDataFrame([row(0, "train", 1.0), row(1, "train", 5.0), row(2, "test", 100.0), row(3, "test", None)], schema)
    x = {r.snapshot_id: r.x for r in vectors.forest_vectors(table).collect()}
    assert x["s3"][0] == 3.0 and x["s3"][1:] == [0.0] * 12 and x["s2"][0] == 100.0


def _scored(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id string, isolation_forest_score double, cluster_changed boolean, timeseries_drift_score double")


def test_final_score(spark):
    rows = _scored(spark, [("a", 100.0, True, 100.0), ("b", 50.0, None, None), ("c", 75.0, False, 100.0)])
    got = {r.snapshot_id: (r.final_anomaly_score, r.anomaly_band) for r in scoring.with_final_score(rows).collect()}
    assert got["a"] == (pytest.approx(100.0), "Critical")
    assert got["b"] == (pytest.approx(20.0), "Normal") and got["c"] == (pytest.approx(65.0), "High")
    with pytest.raises(Exception, match="missing isolation_forest_score for x"):
        scoring.with_final_score(_scored(spark, [("x", None, None, None)])).collect()
