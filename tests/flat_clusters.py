"""Flat clusters of one spanning tree cut in memory from the top, for comparison."""

from __future__ import annotations

import numpy as np


def _merge_tree(u: np.ndarray, v: np.ndarray, weight: np.ndarray):
    """Children and sizes of the nodes made by adding edges in order; leaves come first."""
    leaves = len(weight)
    children = np.zeros((leaves - 1, 2), dtype=np.int64)
    size = np.concatenate([weight, np.zeros(leaves - 1, dtype=weight.dtype)])
    top = np.arange(2 * leaves - 1)
    for i in range(leaves - 1):
        ends = []
        for node in (u[i], v[i]):
            while top[node] != node:
                top[node] = top[top[node]]
                node = top[node]
            ends.append(node)
        children[i] = ends
        top[ends] = leaves + i
        size[leaves + i] = size[ends].sum()
    return children, size


def flat_clusters(
    u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray, core: np.ndarray, min_size: int
) -> np.ndarray:
    """Cluster number per leaf by excess of mass, -1 for noise; the whole is never a cluster.

    ``weight`` counts the copies of a leaf, which part at its core distance.
    """
    leaves = len(weight)
    if weight.sum() < 2 or leaves == 1:
        return np.full(leaves, -1)
    children, size = _merge_tree(u, v, weight)
    with np.errstate(divide="ignore"):
        density = np.concatenate([1.0 / core, 1.0 / w])

    # Walk from the root, splitting a cluster where both sides are large enough.
    cluster_of = np.zeros(2 * leaves - 1, dtype=np.int64)
    parent, birth, mass = [-1], [0.0], [0.0]

    def leave(cluster: int, at: float, rows: float) -> None:
        gained = at - birth[cluster]
        mass[cluster] += 0.0 if np.isnan(gained) else gained * rows

    stack = [2 * leaves - 2]
    while stack:
        node = stack.pop()
        cluster = cluster_of[node]
        if node < leaves:
            if size[node] >= min_size:
                leave(cluster, density[node], size[node])
            continue
        pair = children[node - leaves]
        large = size[pair] >= min_size
        if large.all():
            for child in pair:
                leave(cluster, density[node], size[child])
                cluster_of[child] = len(parent)
                parent.append(cluster)
                birth.append(density[node])
                mass.append(0.0)
        else:
            for child, is_large in zip(pair, large):
                cluster_of[child] = cluster
                if not is_large:
                    leave(cluster, density[node], size[child])
        for child, is_large in zip(pair, large):
            if is_large:
                stack.append(child)
            else:
                _spread(child, cluster_of, children, leaves)

    # Keep a cluster unless the clusters inside it hold more mass.
    inside = np.zeros(len(parent))
    chosen = np.zeros(len(parent), dtype=bool)
    for cluster in range(len(parent) - 1, 0, -1):
        chosen[cluster] = inside[cluster] <= mass[cluster]
        inside[parent[cluster]] += max(mass[cluster], inside[cluster])
    number = np.full(len(parent), -1)
    named = 0
    for cluster in range(1, len(parent)):
        above = number[parent[cluster]]
        if above >= 0:
            number[cluster] = above
        elif chosen[cluster]:
            number[cluster] = named
            named += 1
    return number[cluster_of[:leaves]]


def _spread(node: int, cluster_of: np.ndarray, children: np.ndarray, leaves: int) -> None:
    """Give every node under ``node`` its cluster."""
    stack = [node]
    while stack:
        at = stack.pop()
        if at >= leaves:
            for child in children[at - leaves]:
                cluster_of[child] = cluster_of[at]
                stack.append(child)
