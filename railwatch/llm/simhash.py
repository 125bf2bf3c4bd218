"""Near-duplicates by SimHash fingerprints, found by fuzzy keys of the Golay code.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. If two
fingerprints differ in at most four bits, then either

* some segment is equal and another differs in at most two bits, or
* all three segments differ in at most two bits.

(Order the segments by their errors, at most four in all: if the least is not 0
it is 1, the next is 1, and the last at most 2; if it is 0, the next is at most
2.) So a pair shares one of these keys: an equal segment with a fuzzy key of
another one, or the fuzzy keys of all three. The Golay code turns a segment
into at most six fuzzy keys. The keys have 35 and 36 bits, and what meets under
a key is verified on all 64 bits.

Fingerprints are made distinct before, so copies are never compared. Under one
key only links that join the key's fingerprints into their components are
passed on, not all pairs. A key with more fingerprints than a tile holds is
written as pairs of tiles, which are compared by as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.functions.components import roots
from railwatch.llm import golay
from railwatch.llm.common import bounded_batches, id_order, numbers, raw, text_mark
from railwatch.session import stored

SHINGLE = 4
MAX_BITS = 4
SEED = 42
TILE = 4096
# A task turns so many fingerprints into about 180 keys each.
KEYED_AT_ONCE = 20_000

_SEGMENTS = ((0, 23), (23, 23), (46, 18))
_SHINGLES_AT_ONCE = 50_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z change
    if not words:
        return []
    flat = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, len(words)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    return [hash_of(flat[a:b], SEED) for a, b in zip(starts.tolist(), last)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Majority of the hashes' bits, as an unsigned integer; 0 without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
        part = np.array(hashes[at : at + _SHINGLES_AT_ONCE], "<u8").view(np.uint8)
        votes += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """Majority of the shingle hashes' bits; 0 without words."""
    return majority(shingle_hashes(text))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t or b"") for t in raw(batch.column("text"))], np.uint64)
        names = ["doc_id", "row", "mark"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints.view(np.int64))], [*names, "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its sort key, a hash of the text, and the fingerprint of every row."""
    return (
        bounded_batches(docs)
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            id_order().alias("row"),
            text_mark().alias("mark"),
            "text",
        )
        .mapInArrow(_fingerprints, "doc_id long, row long, mark long, print long")
    )


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint) for all keys of unsigned fingerprints."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in _SEGMENTS]
    coded = [golay.indices(p) for p in parts]
    keys, owners = [], []
    for same in range(3):
        for near in range(3):
            if same != near:
                kind = np.int64(same * 3 + near)
                values, there = coded[near]
                key = (kind << 40) | (parts[same][:, None] << 12) | values
                keys.append(key[there])
                owners.append(np.nonzero(there)[0])
    (a, in_a), (b, in_b), (c, in_c) = coded
    key = (np.int64(15) << 40) | (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    there = in_a[:, :, None, None] & in_b[:, None, :, None] & in_c[:, None, None, :]
    keys.append(key[there])
    owners.append(np.nonzero(there)[0])
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = numbers(batch.column("print"))
        for at in range(0, len(prints), 2000):
            part = prints[at : at + 2000]
            keys, owners = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], ["key", "print"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS  # unsigned: signed counts take the absolute value


def spanning_links(prints: np.ndarray, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever near pairs connect, at most one per fingerprint.

    With ``others``, pairs within either side count too: each side of a pair of
    tiles is searched, so the links of both sides are found together.
    """
    points = prints if others is None else np.concatenate([prints, others])
    links, left = [], np.arange(len(points))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = _near(points[left], points[at])
            links += [(int(points[at]), int(points[i])) for i in left[near]]
            front, left = np.concatenate([front, left[near]]), left[~near]
    return links


def _links_under_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of rows sorted by key; tiles of keys that hold too many."""
    held_key, held = np.empty(0, np.int64), np.empty(0, np.int64)

    def settle(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):
            rows = prints[starts[sizes == size][:, None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    near = _near(rows[:, i], rows[:, j])
                    left.append(rows[near, i])
                    right.append(rows[near, j])
        tiles = []
        for start, size in zip(starts[sizes > 8], sizes[sizes > 8]):
            points = prints[start : start + size]
            if size <= TILE:
                links = np.array(spanning_links(points), np.int64).reshape(-1, 2)
                left.append(links[:, 0])
                right.append(links[:, 1])
            else:
                cut = [points[at : at + TILE // 2].tobytes() for at in range(0, size, TILE // 2)]
                tiles += [(cut[i], cut[j]) for i in range(len(cut)) for j in range(i + 1, len(cut))]
        pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0)
        yield _link_rows(pairs, [])
        for at in range(0, len(tiles), 64):
            yield _link_rows(np.empty((0, 2), np.int64), tiles[at : at + 64])

    for batch in batches:
        keys = np.concatenate([held_key, numbers(batch.column("key"))])
        prints = np.concatenate([held, numbers(batch.column("print"))])
        if not len(keys):
            continue
        cut = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
        yield from settle(keys[:cut], prints[:cut])
        held_key, held = keys[cut:], prints[cut:]
    yield from settle(held_key, held)


def _link_rows(pairs: np.ndarray, tiles: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    blank = [None] * len(tiles)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*pairs[:, 0].tolist(), *blank], pa.int64()),
            pa.array([*pairs[:, 1].tolist(), *blank], pa.int64()),
            pa.array([*[None] * len(pairs), *(t[0] for t in tiles)], pa.binary()),
            pa.array([*[None] * len(pairs), *(t[1] for t in tiles)], pa.binary()),
        ],
        ["node", "to", "tile", "other"],
    )


def _links_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile, other in zip(batch.column("tile").to_pylist(), batch.column("other").to_pylist()):
            links = np.array(spanning_links(np.frombuffer(tile, np.int64), np.frombuffer(other, np.int64)), np.int64)
            links = links.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["node", "to"])


def near_links(prints: DataFrame) -> DataFrame:
    """(node, to): links between distinct ``print`` values that connect all within ``MAX_BITS`` bits."""
    tasks = max(1, -(-prints.count() // KEYED_AT_ONCE))
    found = stored(
        bounded_batches(prints.select("print").distinct())
        .repartition(tasks, "print")
        .mapInArrow(_keyed, "key long, print long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_links_under_keys, "node long, to long, tile binary, other binary"),
        "links",
    )
    # Tiles differ from one another, so dealing them by value spreads them.
    tiles = found.filter("tile is not null").select("tile", "other").repartition("tile", "other")
    tiled = tiles.mapInArrow(_links_of_tiles, "node long, to long")
    return found.filter("tile is null").select("node", "to").unionByName(tiled)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row, mark, print, class, component_id.

    ``print`` is the fingerprint as a signed long, ``class`` one fingerprint that
    stands for the component, ``component_id`` the component's smallest doc_id.

    Null texts and texts without words have fingerprint 0 and link like others.
    Null ids take part; a component's smallest id is taken over the others, and
    is null if there is none. Repeated rows have equal results. Other columns
    are ignored.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    tree = roots(near_links(prints))
    classes = (
        least.join(tree.withColumnRenamed("node", "print"), "print", "left")
        .withColumn("class", F.coalesce("root", "print"))
        .drop("root")
    )
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    members = classes.select("print", "class").join(ids, "class")
    return prints.join(members, "print").select("doc_id", "row", "mark", "print", "class", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest id of every class of near-duplicates, with all its columns; one of repeated rows."""
    least = near_duplicates(docs).groupBy("class").agg(F.min(F.struct("row", "mark")).alias("least"))
    chosen = least.select(F.col("least.row").alias("_row"), F.col("least.mark").alias("_mark"))
    keyed = docs.select("*", id_order().alias("_row"), text_mark().alias("_mark"))
    return keyed.join(chosen, ["_row", "_mark"], "left_semi").dropDuplicates(["_row", "_mark"]).select(*docs.columns)
