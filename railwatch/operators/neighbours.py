"""Nearest neighbours and nearest pairs of points, by boxes.

Points are split at medians into leaves of near points, each with its bounding
box. Queries go through the leaves group by group and leave out the boxes that
lie beyond what they look for. Products of matrices only rule points out, with
room for their rounding; every distance that is kept is summed up by itself.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LEAF_ROWS = 64
QUERY_ROWS = 128
# Leaves looked at together, at most.
LEAF_BATCH = 64


class Tree(NamedTuple):
    """Rows in the order of their leaves, the first of each leaf, and the leaves' boxes."""

    order: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray


def tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    parts, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf_rows:
            parts.append(at)
            continue
        axis = int(np.ptp(x[at], axis=0).argmax())
        half = len(at) // 2
        cut = np.argpartition(x[at, axis], half)
        todo += [at[cut[half:]], at[cut[:half]]]
    order = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    return Tree(order, starts, ends, np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts))


def box_gaps(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Squared distance between each of the boxes ``low``, ``high`` and each of the others."""
    squared = np.zeros((len(low), len(box_low)))
    for position in range(low.shape[1]):
        apart = np.maximum(box_low[None, :, position] - high[:, position, None], low[:, position, None] - box_high[None, :, position])
        np.maximum(apart, 0.0, out=apart)
        squared += apart * apart
    return squared


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    skipped = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - skipped, sizes)


def pair_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distance of each row of ``left`` to the row of ``right`` beside it."""
    squared = np.zeros(len(left))
    for position in range(left.shape[1]):
        squared += (left[:, position] - right[:, position]) ** 2
    return np.sqrt(squared)


def _within(queries: np.ndarray, others: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides that are no farther apart than the query's radius, and their distances."""
    middle = queries.mean(axis=0)
    q, o = queries - middle, others - middle
    q_size, o_size = (q * q).sum(axis=1), (o * o).sum(axis=1)
    squared = q @ o.T
    squared *= -2.0
    squared += o_size[None, :] * (1 - 1e-12)
    limit = radius * radius * (1 + 1e-9) - q_size * (1 - 1e-12)
    i, j = np.nonzero(squared <= limit[:, None])
    apart = pair_distances(queries[i], others[j])
    near = apart <= radius[i]
    return i[near], j[near], apart[near]


def _batches(gaps: np.ndarray, radius, first: int):
    """Leaves from the nearest on, a few and then ever more at a time, as long as the largest radius reaches them."""
    order = np.argsort(gaps, kind="stable")
    at, size, sorted_gaps = 0, first, gaps[order]
    while at < len(order):
        widest = radius()
        reached = int(np.searchsorted(sorted_gaps, widest * widest * (1 + 1e-9), "right"))
        if reached <= at:
            return
        to = min(at + size, reached)
        yield order[at:to]
        at, size = to, min(2 * size, LEAF_BATCH)


def _near_leaves(queries: np.ndarray, radius: np.ndarray, leaves: np.ndarray, tree_: Tree) -> np.ndarray:
    """Those of the leaves that some query reaches."""
    gaps = box_gaps(queries, queries, tree_.low[leaves], tree_.high[leaves])
    return leaves[(gaps <= (radius * radius * (1 + 1e-9))[:, None]).any(axis=0)]


def nearest(
    queries: np.ndarray, bound: np.ndarray, x: np.ndarray, names: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest ``count`` of ``x`` within each query's bound, of equal ones those named first.

    Query, row of ``x`` and distance, sorted by query, distance and name.
    """
    held, asked, found = tree(x), tree(queries, QUERY_ROWS), []
    sorted_x, sorted_names = x[held.order], names[held.order]
    every = box_gaps(asked.low, asked.high, held.low, held.high)
    for group in range(len(asked.starts)):
        rows = asked.order[asked.starts[group] : asked.ends[group]]
        q, radius = queries[rows], bound[rows].copy()
        i, j, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for leaves in _batches(every[group], radius.max, 1 + 4 * count // LEAF_ROWS):
            leaves = _near_leaves(q, radius, leaves, held)
            if not len(leaves):
                continue
            members = _ranges(held.starts[leaves], held.ends[leaves])
            new_i, new_j, new_d = _within(q, sorted_x[members], radius)
            i, j, d = np.concatenate([i, new_i]), np.concatenate([j, members[new_j]]), np.concatenate([d, new_d])
            order = np.lexsort((sorted_names[j], d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            radius[i[place == count - 1]] = d[place == count - 1]
            kept = place < count
            i, j, d = i[kept], j[kept], d[kept]
        found.append((rows[i], held.order[j], d))
    i, j, d = (np.concatenate(part) for part in zip(*found))
    order = np.argsort(i, kind="stable")
    return i[order], j[order], d[order]


def least_of_each(one: np.ndarray, other: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the least edge (w, a, b) of every pair of (one, other)."""
    if not len(w):
        return np.zeros(0, int)
    order = np.lexsort((b, a, w, other, one))
    changed = np.ones(len(order), bool)
    changed[1:] = (np.diff(one[order]) != 0) | (np.diff(other[order]) != 0)
    return order[changed]


class Side(NamedTuple):
    """Points of one side of a search for edges."""

    x: np.ndarray
    name: np.ndarray
    core: np.ndarray
    component: np.ndarray


def nearest_links(asking: Side, radius: np.ndarray, held: Side) -> tuple[np.ndarray, ...]:
    """The least edge below the asking point's radius between each two components: both, both ends, weight."""
    asked, kept = tree(asking.x, QUERY_ROWS), tree(held.x)
    x, name, core, component = (part[kept.order] for part in held)
    lowest, highest = np.minimum.reduceat(component, kept.starts), np.maximum.reduceat(component, kept.starts)
    least_core = np.minimum.reduceat(core, kept.starts)
    every = box_gaps(asked.low, asked.high, kept.low, kept.high)
    found = [tuple(np.zeros(0, t) for t in (int, int, int, int, float))]
    for group in range(len(asked.starts)):
        rows = asked.order[asked.starts[group] : asked.ends[group]]
        q, reach, own = asking.x[rows], radius[rows], asking.component[rows]
        widest = reach.max()
        gaps = every[group].copy()
        gaps[least_core >= widest] = np.inf
        if (own == own[0]).all():
            gaps[(lowest == own[0]) & (highest == own[0])] = np.inf
        parts = []
        for leaves in _batches(gaps, lambda: min(widest, 1e150), LEAF_BATCH):
            leaves = _near_leaves(q, reach, leaves, kept)
            if not len(leaves):
                continue
            members = _ranges(kept.starts[leaves], kept.ends[leaves])
            i, j, d = _within(q, x[members], reach)
            j = members[j]
            w = np.maximum(d, np.maximum(asking.core[rows[i]], core[j]))
            good = (w < reach[i]) & (component[j] != own[i])
            i, j, w = i[good], j[good], w[good]
            one, other, a, b = own[i], component[j], asking.name[rows[i]], name[j]
            best = least_of_each(one, other, w, a, b)
            parts.append((one[best], other[best], a[best], b[best], w[best]))
        if parts:
            one, other, a, b, w = (np.concatenate(part) for part in zip(*parts))
            best = least_of_each(one, other, w, a, b)
            found.append((one[best], other[best], a[best], b[best], w[best]))
    one, other, a, b, w = (np.concatenate(part) for part in zip(*found))
    best = least_of_each(one, other, w, a, b)
    return one[best], other[best], a[best], b[best], w[best]


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, count: int, known: np.ndarray | None = None):
    """A minimum spanning forest of nodes 0 to ``count`` - 1: places of its edges, and a component per node.

    ``known`` says up to which weight the edges of a node are all given; a
    component then grows only by an edge that no missing one can undercut.
    """
    low, high = np.minimum(a, b), np.maximum(a, b)
    place = np.lexsort((high, low, w))
    low, high, w = low[place], high[place], w[place]
    component, every, chosen = np.arange(count), np.arange(count), []
    while len(place):
        one, other = component[low], component[high]
        crossing = one != other
        low, high, w, place, one, other = (part[crossing] for part in (low, high, w, place, one, other))
        if not len(place):
            break
        best = np.full(count, len(place))
        np.minimum.at(best, one, np.arange(len(place)))
        np.minimum.at(best, other, np.arange(len(place)))
        sure = np.flatnonzero(best < len(place))
        if known is not None:
            limit = np.full(count, np.inf)
            np.minimum.at(limit, component, known)
            sure = sure[w[best[sure]] <= limit[sure]]
        if not len(sure):
            break
        edge = best[sure]
        chosen.append(place[np.unique(edge)])
        to = every.copy()
        to[sure] = np.where(one[edge] == sure, other[edge], one[edge])
        mutual = (to[to] == every) & (every < to)
        to[mutual] = every[mutual]
        while True:
            above = to[to]
            if (above == to).all():
                break
            to = above
        component = to[component]
    return (np.concatenate(chosen) if chosen else np.zeros(0, int)), component
