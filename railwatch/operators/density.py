"""Density clusters of snapshots per tenant and segment, and changes of cluster.

Points of a segment are cut into cells of bounded size at medians of a sample.
Neighbours are looked for in a point's own cell, then in the cells whose boxes
lie nearer than those found. The graph of neighbours is merged as far as no
edge outside of it could undercut; between the components left, further edges
are looked for up to the widest step on some tree that joins them. So the result
equals that of comparing all rows. The spanning tree is cut into clusters in
blocks of edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.chunks import map_chunks
from railwatch.functions.joins import join_small
from railwatch.operators import neighbours
from railwatch.operators.hierarchy import BLOCK_EDGES, flat_clusters
from railwatch.operators.vectors import SEGMENT
from railwatch.schema import WEEKLY
from railwatch.session import stored

MIN_CLUSTER_SIZE = 5
# Points of a cell, about; the cells of a segment are cut by a sample of this many points each.
BLOCK_ROWS = 16_000
MAX_CELLS = 4096
CELL_SAMPLE = 64
# A segment of no more points is spanned by comparing all of them.
WHOLE_ROWS = 2000
# Neighbours known per point, itself included.
NEIGHBOURS = 16
VISITOR_ROWS = 50_000
# Pairs of representatives that are compared to join components, per segment and at least per component.
JOINING_PAIRS = 2_000_000
JOINING_LEAST = 32

_GROUP = "tenant_bank_id string, segment string"
_CELL = (*SEGMENT, "cell")


def distinct_points(vectors: DataFrame) -> DataFrame:
    """One weighted point per distinct vector of a segment, so copies cost nothing."""
    points = vectors.groupBy(*SEGMENT, "x").agg(
        F.min("snapshot_id").alias("point_id"), F.count(F.lit(1)).alias("weight")
    )
    sizes = points.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows"))
    needed = F.least(F.lit(MIN_CLUSTER_SIZE), F.col("rows")).cast("int").alias("needed")
    return join_small(points, sizes, SEGMENT).select(*SEGMENT, "point_id", "x", "weight", "n", needed)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")})


_CUTS = f"{_GROUP}, axis array<int>, cut array<double>, below array<int>, above array<int>"


def _cuts(sample: pd.DataFrame) -> pd.DataFrame:
    """Cuts of a segment into cells. A negative child is a cell: -1 the first, -2 the second."""
    x = _vectors(sample.sort_values("point_id")["x"])
    axes, cuts, sides, cells = [], [], ([], []), 0
    todo = [(np.arange(len(x)), int(sample["wanted"].iloc[0]), None)]
    while todo:
        rows, wanted, place = todo.pop()
        axis = int(x[rows].var(axis=0).argmax())
        values = np.sort(x[rows, axis])
        if wanted > 1 and values[0] < values[-1]:
            name, cut = len(axes), values[min(len(values) * (wanted // 2) // wanted, len(values) - 1)]
            cut = cut if cut < values[-1] else values[values < values[-1]][-1]
            under = x[rows, axis] <= cut
            axes.append(axis)
            cuts.append(cut)
            for side in sides:
                side.append(0)
            todo += [(rows[~under], wanted - wanted // 2, (1, name)), (rows[under], wanted // 2, (0, name))]
        else:
            cells += 1
            name = -cells
        if place is not None:
            sides[place[0]][place[1]] = name
    keys = {c: [sample[c].iloc[0]] for c in SEGMENT}
    return pd.DataFrame({**keys, "axis": [axes], "cut": [cuts], "below": [sides[0]], "above": [sides[1]]})


_CELLED = f"{_GROUP}, point_id string, x array<double>, weight long, n long, needed int, cell int"


def _in_cells(points: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
    if points.empty:
        return _empty(_CELLED)
    node = np.full(len(points), -1)
    axis, cut, below, above = (np.asarray(cuts[c].iloc[0]) if len(cuts) else [] for c in ("axis", "cut", "below", "above"))
    if len(axis):
        x, node, every = _vectors(points["x"]), node + 1, np.arange(len(points))
        while (inner := node >= 0).any():
            at = node[inner]
            node[inner] = np.where(x[every[inner], axis[at]] <= cut[at], below[at], above[at])
    return points.drop(columns="__chunk").assign(cell=(-1 - node).astype("int32"))


def placed_points(points: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Points with their cell and a number of their own, and the boxes of the cells."""
    wanted = F.least(F.lit(MAX_CELLS), F.ceil(F.col("n") / block_rows)).cast("int")
    share = F.shiftrightunsigned(F.xxhash64("point_id"), 11) / float(2**53)
    sample = points.withColumn("wanted", wanted).filter(
        (F.col("wanted") > 1) & (share < 1.0 * CELL_SAMPLE * F.col("wanted") / F.col("n"))
    )
    cuts = sample.select(*SEGMENT, "point_id", "x", "wanted").groupBy(*SEGMENT).applyInPandas(_cuts, _CUTS)
    uncut = points.select(*SEGMENT).distinct().join(cuts, list(SEGMENT), "left")
    empty = {c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("axis", "int"), ("cut", "double"), ("below", "int"), ("above", "int"))}
    cuts = stored(uncut.withColumns(empty), "cuts")
    columns = [part.split()[0] for part in _CELLED.split(", ")[:-1]]
    celled = stored(map_chunks(points.select(*columns), cuts, SEGMENT, "point_id", _in_cells, _CELLED), "celled")
    first = celled.select(F.size("x").alias("width")).first()
    edges = [F.array(*(f(F.col("x")[i]) for i in range(first.width if first else 0))) for f in (F.min, F.max)]
    boxes = celled.groupBy(*_CELL).agg(edges[0].alias("low"), edges[1].alias("high"))
    number = F.row_number().over(Window.orderBy(*_CELL)).cast("long").alias("cell_number")
    boxes = stored(boxes.select("*", number), "boxes")
    within = F.row_number().over(Window.partitionBy(*_CELL).orderBy("point_id"))
    numbered = celled.withColumn("within", within).join(F.broadcast(boxes.select(*_CELL, "cell_number")), list(_CELL))
    pid = F.shiftleft("cell_number", 32) + F.col("within")
    return stored(numbered.select(*celled.columns, pid.alias("pid")), "points"), boxes


_FOUND = "pid long, names array<long>, distances array<double>, weights array<long>"


def _listed(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """The nearest of ``points`` within each query's bound."""
    if queries.empty or points.empty:
        return _empty(_FOUND)
    names, weights = points["pid"].to_numpy(), points["weight"].to_numpy()
    bound = queries["bound"].to_numpy(dtype=float)
    i, j, d = neighbours.nearest(_vectors(queries["x"]), bound, _vectors(points["x"]), names, NEIGHBOURS)
    asked, starts = np.unique(i, return_index=True)
    parts = [np.split(part, starts[1:]) for part in (names[j], d, weights[j])] if len(asked) else [[], [], []]
    return pd.DataFrame({"pid": queries["pid"].to_numpy()[asked], "names": parts[0], "distances": parts[1], "weights": parts[2]})


def _visits(rows: DataFrame, boxes: DataFrame, own: bool) -> DataFrame:
    """Points repeated per cell whose box lies within their bound, as its visitors."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "to int"])

    def reached(points: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if points.empty:
            return _empty(schema)
        low, high, cell = _vectors(cells["low"]), _vectors(cells["high"]), cells["cell"].to_numpy()
        found = []
        for start in range(0, len(points), 4096):
            some = points.iloc[start : start + 4096].drop(columns="__chunk")
            x, bound = _vectors(some["x"]), some["bound"].to_numpy(dtype=float)
            near = neighbours.box_gaps(x, x, low, high) <= (bound * bound * (1 + 1e-9))[:, None]
            if not own:
                near &= some["cell"].to_numpy()[:, None] != cell[None, :]
            i, j = np.nonzero(near)
            found.append(some.iloc[i].assign(to=cell[j]))
        return pd.concat(found)

    return map_chunks(rows, boxes.drop("cell_number"), SEGMENT, "pid", reached, schema).withColumn("cell", F.col("to")).drop("to")


def core_distances(placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with their nearest neighbours and ``core``: the distance within which the needed weight lies, itself included.

    ``known`` is the distance up to which all neighbours are listed.
    """
    held = placed.select(*_CELL, "pid", "x", "weight")
    held = held.toDF(*held.columns)  # its own columns, since it is grouped beside the same table
    asking = placed.select(*_CELL, "pid", "x", F.lit(float("inf")).alias("bound"))
    zipped = F.arrays_zip(F.col("distances").alias("d"), F.col("names").alias("q"), F.col("weights").alias("m"))
    own = map_chunks(asking, held, _CELL, "pid", _listed, _FOUND, VISITOR_ROWS)
    own = stored(own.select("pid", zipped.alias("near")), "own")
    full = F.when(F.size("near") >= NEIGHBOURS, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    bounded = placed.select(*_CELL, "pid", "x").join(own.select("pid", full.alias("bound")), "pid")
    several = boxes.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("cells")).filter("cells > 1")
    bounded = join_small(bounded, several, SEGMENT).select(*_CELL, "pid", "x", "bound")
    visitors = stored(_visits(bounded, boxes, own=False), "visitors")
    met = map_chunks(visitors, held, _CELL, "pid", _listed, _FOUND, VISITOR_ROWS).select("pid", zipped.alias("near"))
    lists = own.unionByName(met).groupBy("pid").agg(F.flatten(F.collect_list("near")).alias("near"))
    near = F.slice(F.array_sort("near"), 1, NEIGHBOURS).alias("near")
    joined = placed.join(lists.select("pid", near), "pid")
    reached = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("long").alias("within"), F.lit(None).cast("double").alias("core")),
        lambda at, n: F.when(at["within"] >= F.col("needed"), at).otherwise(
            F.struct((at["within"] + n["m"]).alias("within"), n["d"].alias("core"))
        ),
    )
    return stored(joined.select(*placed.columns, "near", full.alias("known"), reached["core"].alias("core")), "cores")


def _pair_edges(points: pd.DataFrame) -> pd.DataFrame:
    """The spanning tree of a few points under mutual reachability, by comparing all."""
    points = points.sort_values("point_id").reset_index(drop=True)
    x, core = _vectors(points["x"]), points["core"].to_numpy()
    count = len(points)
    best, parent, done = np.full(count, np.inf), np.zeros(count, int), np.zeros(count, bool)
    at, edges = 0, []
    for _ in range(count - 1):
        done[at] = True
        reach = np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), np.maximum(core, core[at]))
        closer = ~done & (reach < best)
        best[closer], parent[closer] = reach[closer], at
        at = int(np.where(done, np.inf, best).argmin())
        edges.append((parent[at], at, best[at]))
    ids = points["point_id"].to_numpy()
    out = pd.DataFrame([(*sorted((ids[a], ids[b])), w) for a, b, w in edges], columns=["u", "v", "w"])
    return out.assign(**{c: points[c].iloc[0] for c in SEGMENT})[[*SEGMENT, "u", "v", "w"]]


_EDGE = f"{_GROUP}, a long, b long, w double"


def _cell_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges of a cell without those that no spanning tree needs."""
    ends, numbers = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = numbers.reshape(-1, 2).T
    kept, _ = neighbours.forest(a, b, edges["w"].to_numpy(), len(ends))
    return edges[[*SEGMENT, "a", "b", "w"]].iloc[kept]


_JOINED = f"{_GROUP}, kind string, pid long, component long, radius double, a long, b long, one long, other long, w double"


def _joining(x: np.ndarray, core: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between representatives that join all of them, mostly near ones."""
    order = reps[neighbours.tree(x[reps], 8).order]
    window = min(len(order) - 1, max(JOINING_LEAST, JOINING_PAIRS // len(order)))
    a = np.concatenate([order[:-step] for step in range(1, window + 1)])
    b = np.concatenate([order[step:] for step in range(1, window + 1)])
    parts = []
    for start in range(0, len(a), 1 << 18):
        some, others = a[start : start + (1 << 18)], b[start : start + (1 << 18)]
        apart = neighbours.pair_distances(x[some], x[others])
        parts.append(np.maximum(apart, np.maximum(core[some], core[others])))
    return a, b, np.concatenate(parts)


def _radii(one: np.ndarray, other: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far each component is to look: up to the widest step at which it is on the smaller side."""
    top, members, radius = list(range(len(sizes))), [[i] for i in range(len(sizes))], np.zeros(len(sizes))
    rows = sizes.tolist()
    for at in np.argsort(w, kind="stable"):
        i, j = int(one[at]), int(other[at])
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        while top[j] != j:
            top[j] = top[top[j]]
            j = top[j]
        if rows[i] < rows[j]:
            i, j = j, i
        radius[members[j]] = w[at]
        members[i] += members[j]
        rows[i] += rows[j]
        members[j], top[j] = [], i
    return radius


def _components(edges: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """What the known edges of a segment settle: edges of its tree, components, and how far these must look for others.

    Links are known edges between components, and enough others to join them all.
    """
    points = points.sort_values("pid")
    names, core, x = points["pid"].to_numpy(), points["core"].to_numpy(), _vectors(points["x"])
    a, b = (np.searchsorted(names, edges[c].to_numpy()) for c in "ab")
    w = edges["w"].to_numpy()
    settled, component = neighbours.forest(a, b, w, len(names), points["known"].to_numpy())
    tree = [("edge", a[settled], b[settled], w[settled])]
    radius = np.zeros(len(names))
    roots, numbers = np.unique(component, return_inverse=True)
    if len(roots) > 1:
        order = np.lexsort((names, core, numbers))
        reps = order[np.searchsorted(numbers[order], np.arange(len(roots)))]
        apart = component[a] != component[b]
        more = _joining(x, core, reps)
        a, b, w = (np.concatenate([known[apart], new]) for known, new in zip((a, b, w), more))
        kept, _ = neighbours.forest(numbers[a], numbers[b], w, len(roots))
        tree.append(("link", a[kept], b[kept], w[kept]))
        radius = _radii(numbers[a[kept]], numbers[b[kept]], w[kept], np.bincount(numbers))[numbers]
    rows = [pd.DataFrame({"kind": "point", "pid": names, "component": component, "radius": radius})]
    for kind, u, v, weight in tree:
        rows.append(pd.DataFrame({"kind": kind, "a": names[u], "b": names[v], "one": component[u], "other": component[v], "w": weight}))
    columns = [part.split()[0] for part in _JOINED.split(", ")]
    made = pd.concat(rows).assign(**{c: points[c].iloc[0] for c in SEGMENT})[columns]
    return made.astype({c: "Int64" for c in ("pid", "component", "a", "b", "one", "other")})


_LINK = f"{_GROUP}, one long, other long, a long, b long, w double"


def _links(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The least edges from visitors to points of other components of the cell they visit."""
    if asking.empty or held.empty:
        return _empty(_LINK)
    sides = [
        neighbours.Side(_vectors(s["x"]), s["pid"].to_numpy(), s["core"].to_numpy(), s["component"].to_numpy())
        for s in (asking, held)
    ]
    found = neighbours.nearest_links(sides[0], asking["bound"].to_numpy(), sides[1])
    keys = {c: held[c].iloc[0] for c in SEGMENT}
    return pd.DataFrame(dict(zip(("one", "other", "a", "b", "w"), found))).assign(**keys)[[*SEGMENT, "one", "other", "a", "b", "w"]]


def _joined(links: pd.DataFrame) -> pd.DataFrame:
    """The tree of the components of a segment."""
    links = links.sort_values(["w", "a", "b"])
    ends, numbers = np.unique(links[["one", "other"]].to_numpy(), return_inverse=True)
    one, other = numbers.reshape(-1, 2).T
    kept, _ = neighbours.forest(one, other, links["w"].to_numpy(), len(ends))
    return links[[*SEGMENT, "a", "b", "w"]].iloc[kept]


def _graph_edges(cored: DataFrame, boxes: DataFrame) -> DataFrame:
    """The spanning tree of segments of many points, by numbers of points."""
    near = cored.select(*_CELL, F.col("pid").alias("a"), "core", F.explode("near").alias("near"))
    pairs = near.select(*_CELL, "a", "core", F.col("near.q").alias("b"), F.col("near.d").alias("d")).filter("a <> b")
    ends = cored.select(F.col("pid").alias("b"), F.col("core").alias("end_core"))
    weighed = pairs.join(ends, "b").select(*_CELL, "a", "b", F.greatest("d", "core", "end_core").alias("w"))
    edges = stored(weighed.groupBy(*_CELL).applyInPandas(_cell_forest, _EDGE), "near_edges")
    points = cored.select(*SEGMENT, "pid", "x", "core", "known")
    made = edges.groupBy(*SEGMENT).cogroup(points.groupBy(*SEGMENT)).applyInPandas(_components, _JOINED)
    made = stored(made, "components")
    settled = made.filter("kind = 'edge'").select(*SEGMENT, "a", "b", "w")
    links = made.filter("kind = 'link'").select(*SEGMENT, "one", "other", "a", "b", "w")
    if links.isEmpty():
        return settled
    labels = made.filter("kind = 'point'").select("pid", "component", F.col("radius").alias("bound"))
    held = stored(cored.select(*_CELL, "pid", "x", "core", "known").join(labels, "pid"), "labelled")
    asking = held.filter((F.col("known") < F.col("bound")) & (F.col("core") < F.col("bound")))
    visitors = stored(_visits(asking.drop("known"), boxes, own=True), "askers")
    held = held.drop("known", "bound")
    found = map_chunks(visitors, held, _CELL, "pid", _links, _LINK, VISITOR_ROWS)
    joined = links.unionByName(stored(found, "links")).groupBy(*SEGMENT).applyInPandas(_joined, _EDGE)
    return settled.unionByName(joined)


def candidate_edges(cored: DataFrame, boxes: DataFrame) -> DataFrame:
    """Edges that contain a minimum spanning tree of every segment."""
    several = boxes.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("cells")).filter("cells > 1")
    several = several.select(*SEGMENT, F.lit(True).alias("several"))
    whole = F.col("several").isNull() & (F.col("n") <= WHOLE_ROWS)
    marked = join_small(cored, several, SEGMENT, "left")
    edges = marked.filter(whole).groupBy(*SEGMENT).applyInPandas(_pair_edges, f"{_GROUP}, u string, v string, w double")
    large = marked.filter(~whole).drop("several")
    if not large.isEmpty():
        graph = _graph_edges(large, boxes)
        for end in "ab":
            graph = graph.join(cored.select(F.col("pid").alias(end), F.col("point_id").alias(f"{end}_id")), end)
        edges = edges.unionByName(graph.select(*SEGMENT, F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), "w"))
    return stored(edges, "edges")


def spanning_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The minimum spanning tree of each segment, by rounds of cheapest outgoing edges.

    Every round at least halves the number of components. A segment that fits
    one block has no spare edges and ends at once.
    """
    counts = edges.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("edges"))
    sizes = points.groupBy(*SEGMENT).agg((F.count(F.lit(1)) - 1).alias("tree"))
    spare = stored(sizes.join(counts, list(SEGMENT)).filter("edges > tree").select(*SEGMENT), "spare")
    if spare.isEmpty():
        return edges.select(*SEGMENT, "u", "v", "w")
    trees = [join_small(edges, spare, SEGMENT, "left_anti")]
    left = stored(join_small(edges, spare, SEGMENT, "left_semi"), "left")
    members = join_small(points, spare, SEGMENT, "left_semi").select(
        *SEGMENT, "point_id", F.col("point_id").alias("component")
    )
    while not left.isEmpty():
        ends = {s: members.select(*SEGMENT, F.col("point_id").alias(s), F.col("component").alias(f"c{s}")) for s in "uv"}
        crossing = (
            left.join(ends["u"], [*SEGMENT, "u"]).join(ends["v"], [*SEGMENT, "v"]).filter(F.col("cu") != F.col("cv"))
        )
        crossing = stored(crossing, "crossing")
        if crossing.isEmpty():
            break
        outgoing = crossing.select(*SEGMENT, F.col("cu").alias("component"), F.col("cv").alias("other"), "u", "v", "w")
        outgoing = outgoing.unionByName(
            crossing.select(*SEGMENT, F.col("cv").alias("component"), F.col("cu").alias("other"), "u", "v", "w")
        )
        cheapest = stored(
            outgoing.groupBy(*SEGMENT, "component").agg(F.min(F.struct("w", "u", "v", "other")).alias("best")), "cheapest"
        )
        trees.append(cheapest.select(*SEGMENT, "best.u", "best.v", "best.w").distinct())
        roots = _roots(cheapest.select(*SEGMENT, "component", F.col("best.other").alias("other")))
        members = stored(
            members.join(roots, [*SEGMENT, "component"], "left").select(
                *SEGMENT, "point_id", F.coalesce("root", "component").alias("component")
            ),
            "members",
        )
        left = crossing.select(*SEGMENT, "u", "v", "w")
    tree = trees[0].select(*SEGMENT, "u", "v", "w")
    for part in trees[1:]:
        tree = tree.unionByName(part)
    return tree


def _roots(pointers: DataFrame) -> DataFrame:
    """Follow each component's cheapest edge to the pair that chose each other; the smaller is the root."""
    back = pointers.select(*SEGMENT, F.col("component").alias("other"), F.col("other").alias("back"))
    own = (F.col("back") == F.col("component")) & (F.col("component") < F.col("other"))
    joined = pointers.join(back, [*SEGMENT, "other"], "left")
    roots = stored(
        joined.select(*SEGMENT, "component", F.when(own, F.col("component")).otherwise(F.col("other")).alias("root")), "roots"
    )
    while True:
        above = roots.select(*SEGMENT, F.col("component").alias("root"), F.col("root").alias("above"))
        jumped = stored(
            roots.join(above, [*SEGMENT, "root"]).select(
                *SEGMENT, "component", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")
            ),
            "jumped",
        )
        if jumped.filter("moved").isEmpty():
            return jumped.drop("moved")
        roots = jumped.drop("moved")


def density_clusters(vectors: DataFrame, block_rows: int = BLOCK_ROWS, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``cluster_id`` per snapshot; -1 is noise."""
    points = stored(distinct_points(vectors), "distinct")
    placed, boxes = placed_points(points, block_rows)
    cored = core_distances(placed, boxes)
    tree = stored(spanning_edges(candidate_edges(cored, boxes), cored), "tree")
    labels = flat_clusters(tree, cored.select(*SEGMENT, "point_id", "weight", "core", "needed"), block_edges)
    by_vector = points.join(labels, [*SEGMENT, "point_id"]).select(*SEGMENT, "x", "cluster_id")
    return vectors.join(by_vector, [*SEGMENT, "x"]).select("snapshot_id", *SEGMENT, "cluster_id")


def with_cluster_change(clustered: DataFrame) -> DataFrame:
    """Whether a merchant's cluster differs from its previous week; null on first and to-date rows."""
    weeks = Window.partitionBy("tenant_bank_id", "party_id", "window_type").orderBy("window_start")
    previous = F.lag("cluster_id").over(weeks)
    return clustered.withColumn(
        "cluster_changed", F.when(F.col("window_type") == WEEKLY, F.col("cluster_id") != previous)
    )


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Rows, parties, clusters and noise per segment."""
    noise = F.col("cluster_id") == -1
    return clustered.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("rows_clustered"),
        F.count_distinct("party_id").alias("distinct_parties"),
        F.count_distinct(F.when(~noise, F.col("cluster_id"))).alias("n_clusters"),
        F.count_if(noise).alias("noise_count"),
    )


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy(*SEGMENT, "cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
