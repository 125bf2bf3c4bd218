"""Clusters of a spanning tree by excess of mass, cut in blocks of edges from the bottom up.

Edges are added in order, a block at a time. The edges of a block fall into
components; those that meet are merged in one group, which holds no more than
the block's edges and the nodes at their ends. What has been merged is carried
on as one node: its size, the cluster it is, the mass gathered so far, and the
few points of it while it is too small to be a cluster. So no group grows with
the segment.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.components import roots
from railwatch.functions.ranks import row_rank, running_totals, tie_bucket
from railwatch.operators.vectors import SEGMENT
from railwatch.session import stored

BLOCK_EDGES = 200_000
# Components of a block are dealt out so that a group holds about this many edges, or one component.
GROUP_EDGES = 5_000

_MADE = (
    "tenant_bank_id string, segment string, kind string, node string, root string, size long, cluster string, "
    "gathered double, inside double, loose array<string>, needed int, chosen boolean"
)
_STATE = ("node", "size", "cluster", "gathered", "inside", "loose", "needed")


class _Forest:
    """The nodes of a group while edges are added to them."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        self.at = {name: i for i, name in enumerate(nodes["node"])}
        self.names = nodes["node"].tolist()
        self.size = nodes["size"].tolist()
        self.cluster = [c if isinstance(c, str) else None for c in nodes["cluster"]]
        self.gathered = nodes["gathered"].tolist()
        self.inside = nodes["inside"].tolist()
        self.loose = [list(points) for points in nodes["loose"]]
        self.top = list(range(len(self.names)))
        self.assigned: list[tuple[str, str]] = []
        self.closed: list[tuple[str, str, bool]] = []

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = self.top[i]
        return i

    def _close(self, i: int, density: float, above: str) -> float:
        """End a cluster where it joins another; the mass that it or the clusters inside it keep."""
        mass = 0.0 if math.isinf(density) else self.gathered[i] - density * self.size[i]
        self.closed.append((self.cluster[i], above, self.inside[i] <= mass))
        return max(mass, self.inside[i])

    def _settle(self, i: int, density: float, into: int) -> None:
        """The points of a node too small to be a cluster belong to the cluster it joins."""
        self.gathered[into] += density * self.size[i]
        self.assigned += [(point, self.cluster[into]) for point in self.loose[i]]
        self.loose[i] = []

    def add(self, a: str, b: str, distance: float, name: str, needed: int) -> None:
        i, j = self.find(self.at[a]), self.find(self.at[b])
        density = 1.0 / distance if distance else math.inf
        if self.cluster[i] is None or (self.cluster[j] is not None and self.names[j] < self.names[i]):
            i, j = j, i  # i stays: the one that is a cluster, or of two the one named first
        if self.cluster[i] is not None and self.cluster[j] is not None:
            self.inside[i] = self._close(i, density, name) + self._close(j, density, name)
            self.cluster[i], self.gathered[i] = name, density * (self.size[i] + self.size[j])
        elif self.cluster[i] is not None:
            self._settle(j, density, i)
        else:
            self.loose[i] += self.loose[j]
        self.size[i] += self.size[j]
        self.top[j] = i
        if self.cluster[i] is None and self.size[i] >= needed:
            self.cluster[i], self.gathered[i], self.inside[i] = name, density * self.size[i], 0.0
            self.assigned += [(point, name) for point in self.loose[i]]
            self.loose[i] = []


def _merged(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    columns = [part.split()[0] for part in _MADE.split(", ")]
    if edges.empty:
        return pd.DataFrame({c: [] for c in columns})
    forest, needed = _Forest(nodes), int(nodes["needed"].iloc[0])
    ordered = edges.sort_values("rank")
    for row in zip(ordered["a"], ordered["b"], ordered["w"], ordered["edge"]):
        forest.add(*row, needed)
    rows = []
    for i, name in enumerate(forest.names):
        root = forest.find(i)
        if root == i:
            state = (forest.size[i], forest.cluster[i], forest.gathered[i], forest.inside[i], forest.loose[i])
            rows.append(("node", name, None, *state, needed, None))
        else:
            rows.append(("moved", name, forest.names[root], None, None, None, None, None, None, None))
    rows += [("point", p, None, None, c, None, None, None, None, None) for p, c in forest.assigned]
    rows += [("cluster", None, above, None, c, None, None, None, None, chosen) for c, above, chosen in forest.closed]
    made = pd.DataFrame(rows, columns=columns[2:])
    return made.assign(**{c: edges[c].iloc[0] for c in SEGMENT})[columns]


def _merge_block(now: DataFrame, nodes: DataFrame, whole: bool) -> DataFrame:
    """Merge the nodes that the edges of a block touch; ``whole`` says that a segment is one component."""
    if whole:
        edges, touched = now.withColumn("share", F.lit(0)), nodes.withColumn("share", F.lit(0))
    else:
        links = now.select(*SEGMENT, F.col("a").alias("node"), F.col("b").alias("to"))
        found = roots(links, SEGMENT)
        ends = now.select(*SEGMENT, F.explode(F.array("a", "b")).alias("node")).distinct()
        shares = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / GROUP_EDGES)).cast("int")
        shares = now.groupBy(*SEGMENT).agg(shares.alias("shares"))
        placed = ends.join(found, [*SEGMENT, "node"], "left").join(shares, list(SEGMENT))
        share = F.pmod(F.xxhash64(F.coalesce("root", "node")), F.col("shares")).cast("int").alias("share")
        placed = stored(placed.select(*SEGMENT, "node", share), "placed")
        edges = now.join(placed.withColumnRenamed("node", "a"), [*SEGMENT, "a"])
        touched = nodes.join(placed.select(*SEGMENT, "node", F.col("share").alias("share")), [*SEGMENT, "node"])
    keys = [*SEGMENT, "share"]
    return stored(edges.groupBy(*keys).cogroup(touched.groupBy(*keys)).applyInPandas(_merged, _MADE), "merged")


def _of_kind(made: DataFrame, kind: str, *columns: str) -> DataFrame:
    return made.filter(F.col("kind") == kind).select(*SEGMENT, *columns)


def _topmost_chosen(clusters: DataFrame) -> DataFrame:
    """For every cluster the outermost chosen one around it, by doubling the way up in each round."""
    best = F.when(F.col("chosen"), F.col("cluster")).alias("best")
    state = stored(clusters.select(*SEGMENT, "cluster", F.col("root").alias("up"), best), "up")
    while not state.filter("up is not null").isEmpty():
        above = state.select(*SEGMENT, F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("best").alias("higher"))
        joined = state.join(above, [*SEGMENT, "up"], "left")
        state = stored(joined.select(*SEGMENT, "cluster", F.col("next").alias("up"), F.coalesce("higher", "best").alias("best")), "up")
    return state.filter("best is not null").select(*SEGMENT, "cluster", "best")


def flat_clusters(tree: DataFrame, points: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``cluster_id`` per point, -1 for noise; the whole of a segment is never a cluster.

    ``tree(segment, u, v, w)`` spans the points of each segment;
    ``points(segment, point_id, weight, core, needed)`` weighs them: copies part
    at their core distance.
    """
    named = tree.select(*SEGMENT, "u", "v", "w", F.concat_ws("|", "u", "v").alias("edge"))
    ranked = row_rank(named, SEGMENT, "w", "edge", "rank")
    left = ranked.select(*SEGMENT, F.col("u").alias("a"), F.col("v").alias("b"), "w", "edge", "rank")
    left = stored(left.withColumn("block", F.floor(F.col("rank") / block_edges)), "ranked")
    last = left.agg(F.max("block")).first()[0]

    heavy = F.col("weight") >= F.col("needed")
    density = F.when(F.col("core") > 0, 1.0 / F.col("core")).otherwise(F.lit(float("inf")))
    nodes = points.select(
        *SEGMENT,
        F.col("point_id").alias("node"),
        F.col("weight").alias("size"),
        F.when(heavy, F.col("point_id")).alias("cluster"),
        F.when(heavy, density * F.col("weight")).otherwise(0.0).alias("gathered"),
        F.lit(0.0).alias("inside"),
        F.when(heavy, F.array().cast("array<string>")).otherwise(F.array("point_id")).alias("loose"),
        "needed",
    )
    assigned = points.filter(heavy).select(*SEGMENT, F.col("point_id").alias("node"), F.col("point_id").alias("cluster"))
    closed = None
    for block in range(0 if last is None else last + 1):
        made = _merge_block(left.filter(F.col("block") == block), nodes, whole=last == 0)
        assigned = assigned.unionByName(_of_kind(made, "point", "node", "cluster"))
        ended = _of_kind(made, "cluster", "cluster", "root", "chosen")
        closed = ended if closed is None else closed.unionByName(ended)
        moved = _of_kind(made, "moved", "node", "root")
        kept = nodes.join(made.filter("node is not null and kind in ('node', 'moved')"), [*SEGMENT, "node"], "left_anti")
        nodes = stored(kept.unionByName(_of_kind(made, "node", *_STATE)), "nodes")
        left = left.filter(F.col("block") > block)
        for end in "ab":
            to = moved.select(*SEGMENT, F.col("node").alias(end), F.col("root").alias("moved_to"))
            left = left.join(to, [*SEGMENT, end], "left").withColumn(end, F.coalesce("moved_to", end)).drop("moved_to")
        left = stored(left, "left")
    none = F.lit(None).cast("string").alias("root")
    wholes = nodes.filter("cluster is not null").select(*SEGMENT, "cluster", none, F.lit(False).alias("chosen"))
    tops = _topmost_chosen(wholes if closed is None else closed.unionByName(wholes))
    numbered = running_totals(tops.select(*SEGMENT, "best").distinct(), SEGMENT, {"bucket": tie_bucket("best")}, ["best"], {"number": F.lit(1)})
    labels = assigned.join(tops, [*SEGMENT, "cluster"]).join(numbered, [*SEGMENT, "best"])
    labels = labels.select(*SEGMENT, F.col("node").alias("point_id"), (F.col("number") - 1).cast("int").alias("found"))
    return points.select(*SEGMENT, "point_id").join(labels, [*SEGMENT, "point_id"], "left").select(
        *SEGMENT, "point_id", F.coalesce("found", F.lit(-1)).alias("cluster_id")
    )
