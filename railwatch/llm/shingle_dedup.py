"""One document of each class of near-duplicates: word shingles with a Jaccard similarity of 0.8 or more.

Documents with equal sets of shingles are one node. Two nodes are linked if
their sets are similar enough, which is always verified on the whole sets.

1. Fingerprints of the sets are linked by their Golay keys as in ``simhash``.
   Verified, these links join most of what is alike. They cannot join all of
   it: at a similarity of 0.8 about ten of 64 bits differ, and keys that allow
   as many would meet between any two documents.
2. So every pair is also looked for under the shingles of a prefix. In a fixed
   order of all shingles, two similar sets share one of the first
   ``n - ceil(0.8 n) + 1`` of either. Any order is right; this one puts shingles
   last that are frequent among some documents, so that few nodes meet.
3. Under a shingle, each node is compared with one leader at first, in a few
   rounds with other leaders, starting with the first shingles of each node. What is joined by then needs no comparison; all
   other pairs whose sizes and places allow the similarity are compared.

Beside each node lie its size and a parity bitmap of its set: bit b is the parity
of the shingles that fall on b. Bits in which two bitmaps differ never outnumber
the shingles that only one set has, and at 0.8 these are at most a ninth of both
sizes together. So most candidates are ruled out exactly without their texts.

Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railwatch.functions.components import roots
from railwatch.functions.joins import join_small
from railwatch.llm import simhash
from railwatch.llm.common import bounded_batches, giving_back, id_order, numbers, raw, text_mark
from railwatch.llm.substring_dedup import _compressed, _expanded
from railwatch.session import stored

SHINGLE = 5
# Similarity asked for, in tenths.
TENTHS = 8
# Rounds with leaders, each under so many first shingles of a node (None: all of its prefix). The short ones
# join large groups of copies while few pairs are made.
ROUNDS = (2, 16, None)
# Longs of a parity bitmap.
BITMAP = 16
# The order of shingles is learned from one in so many sets, from all where they are fewer than so many times
# the second number; those in this many of them are frequent.
ORDER_SHARE = 8
ORDER_SETS = 10_000
FREQUENT = 3
FREQUENT_KEPT = 200_000
# Pairs of one task that looks their texts up.
PAIRS_AT_ONCE = 5_000


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(simhash.shingle_hashes(text or b"", size), np.uint64))


def prefix_size(count: int) -> int:
    """A set of ``count`` shares one of so many first shingles with every set similar to it."""
    return count + (-TENTHS * count // 10) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 10 * min(len(a), len(b)) < TENTHS * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * shared >= TENTHS * (len(a) + len(b) - shared)


def parity_bitmap(found: np.ndarray) -> np.ndarray:
    """``BITMAP`` longs; each shingle flips the bit that its upper part names."""
    bits = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_similar(size_a: Column, size_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """False only for pairs of sets whose similarity is below TENTHS / 10."""
    apart = sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(BITMAP)), F.lit(0))
    sizes = size_a + size_b
    near = F.least(size_a, size_b) * 10 >= F.greatest(size_a, size_b) * TENTHS
    return near & (apart * (10 + TENTHS) <= sizes * (10 - TENTHS))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, sizes, bits = [], [], [], []
        for text in raw(batch.column("text")):
            found = shingle_set(text)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED))
            prints.append(simhash.majority(found))
            sizes.append(len(found))
            bits.append(parity_bitmap(found))
        made = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, prints)]
        made += [pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("mark"), *made], ["row", "mark", "node", "print", "size", "bits"])


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.empty(0, np.uint64), *map(shingle_set, _expanded(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])


def _prefixes(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, node, place, size) for the first shingles of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, uses = shared.value  # ascending, with their counts
        for batch in batches:
            parts = []
            for node, text in zip(numbers(batch.column("node")).tolist(), _expanded(batch.column("text"))):
                found = shingle_set(text)
                if not len(found):
                    continue
                rank = np.zeros(len(found), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                    rank = np.where(frequent[at] == found, uses[at], 0)
                first = found[np.lexsort((found, rank))][: prefix_size(len(found))]
                count = len(first)
                parts.append((first.view(np.int64), np.full(count, node), np.arange(count), np.full(count, len(found))))
            if parts:
                arrays = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "place", "size"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar; rows come sorted by ``node``, whose set is made once."""
    held, mine = None, None
    for batch in batches:
        nodes, others = numbers(batch.column("node")), numbers(batch.column("to"))
        keep = np.zeros(len(nodes), bool)
        for i, (node, text, other) in enumerate(zip(nodes, _expanded(batch.column("text")), _expanded(batch.column("other")))):
            if node != held:
                held, mine = node, shingle_set(text)
            keep[i] = similar(mine, shingle_set(other))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(others[keep])], ["node", "to"])


def _not_ruled_out(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, to) of ``pairs`` that their bitmaps leave."""
    ends = {c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("node", "to")}
    described = pairs.join(ends["node"], "node").join(ends["to"], "to")
    return described.filter(may_be_similar(*(F.col(c) for c in ("size_node", "size_to", "bits_node", "bits_to")))).select("node", "to")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, to) of ``pairs`` whose sets are similar; only these pairs need their texts."""
    pairs = stored(pairs, "pairs")
    tasks = max(1, -(-pairs.count() // PAIRS_AT_ONCE))
    asked = pairs.select("node").unionByName(pairs.select(F.col("to").alias("node"))).coalesce(tasks).distinct()
    texts = stored(join_small(texts, asked, ["node"], "left_semi"), "asked")
    both = pairs.coalesce(tasks).join(texts, "node").join(texts.select(F.col("node").alias("to"), F.col("text").alias("other")), "to")
    rows = both.select("node", "to", "text", "other").coalesce(tasks).repartition("node", "to").sortWithinPartitions("node")
    return stored(rows.mapInArrow(giving_back(_verified), "node long, to long").coalesce(tasks), "verified")


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("node"), F.greatest(a, b).alias("to")]


def _keys_in_common(texts: DataFrame) -> DataFrame:
    """key, node, place, size: the prefix shingles that several nodes have."""
    one_in = max(1, min(ORDER_SHARE, texts.count() // ORDER_SETS))
    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).select("text")
    counted = sample.mapInArrow(giving_back(_all_shingles), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    frequent = counted.filter(F.col("uses") >= FREQUENT).orderBy(F.desc("uses"), "key").limit(FREQUENT_KEPT).toArrow()
    found, uses = numbers(frequent["key"].combine_chunks()).view(np.uint64), numbers(frequent["uses"].combine_chunks())
    order = np.argsort(found)
    shared = texts.sparkSession.sparkContext.broadcast((found[order], uses[order]))
    keyed = texts.mapInArrow(giving_back(_prefixes(shared)), "key long, node long, place long, size long")
    several = F.count(F.lit(1)).over(Window.partitionBy("key")) > 1
    return stored(keyed.withColumn("several", several).filter("several").drop("several"), "keyed")


def _classed(rows: DataFrame, tree: DataFrame) -> DataFrame:
    return rows.join(tree, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")


def _grown(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of what the tree so far and more links connect."""
    return roots(tree.withColumnRenamed("root", "to").unionByName(links))


def _linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of what links between similar nodes connect."""
    of_print = nodes.groupBy("print").agg(F.min("node").alias("first"))
    alike = nodes.select("node", "print").join(of_print, "print").filter("node <> first").select(*_pairs("node", "first"))
    near = simhash.near_links(of_print.select("print")).select("node", "to").distinct()
    near = near.join(of_print.select(F.col("print").alias("node"), F.col("first").alias("a")), "node")
    near = near.join(of_print.select(F.col("print").alias("to"), F.col("first").alias("b")), "to")
    tree = roots(_verify(_not_ruled_out(alike.unionByName(near.select(*_pairs("a", "b"))).distinct(), nodes), texts))

    keyed = _keys_in_common(texts)
    for turn, places in enumerate(ROUNDS):
        classed = _classed(keyed if places is None else keyed.filter(F.col("place") < places), tree)
        # The leader of a shingle is the node with the least hash of this turn.
        led = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("hash"), "node", "class", "size"))
        leaders = classed.groupBy("key").agg(led.alias("leader"))
        met = classed.join(leaders, "key").filter("class <> leader.class")
        met = met.filter(F.least("size", "leader.size") * 10 >= F.greatest("size", "leader.size") * TENTHS)
        met = met.select(*_pairs("node", "leader.node")).distinct()
        tree = _grown(tree, _verify(_not_ruled_out(met, nodes), texts))

    classed = stored(_classed(keyed, tree), "classed")
    # Keys whose nodes are one class have nothing left to compare.
    mixed = classed.groupBy("key").agg((F.min("class") < F.max("class")).alias("mixed")).filter("mixed").select("key")
    # Pairs grow with the square of those under a key, so the bitmaps come with the rows: only pairs that they leave are made.
    left = classed.join(mixed, "key", "left_semi").join(nodes.select("node", "bits"), "node")
    a, b = left.alias("a"), left.alias("b")
    sizes = F.col("a.size") + F.col("b.size")
    # Under the first shingle in common, only it and those behind it can be shared.
    most = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    rest = a.join(b, F.col("a.key") == F.col("b.key")).filter("a.node < b.node and a.class <> b.class")
    rest = rest.filter(most * (10 + TENTHS) >= sizes * TENTHS)
    rest = rest.filter(may_be_similar(*(F.col(c) for c in ("a.size", "b.size", "a.bits", "b.bits"))))
    return _grown(tree, _verify(rest.select(F.col("a.node").alias("node"), F.col("b.node").alias("to")).distinct(), texts))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest id of every class of near-duplicates, with all its columns; one of repeated rows.

    A class is what links between documents of Jaccard similarity 0.8 or more
    connect. A-Z count as a-z; a text of fewer than five words is one shingle;
    texts without words, null ones too, are one class. A null id sorts first.
    """
    keyed = docs.select("*", id_order().alias("_row"), text_mark().alias("_mark"))
    rows = bounded_batches(keyed).select(F.col("_row").alias("row"), F.col("_mark").alias("mark"), "text")
    nodes = stored(rows.mapInArrow(giving_back(_nodes), "row long, mark long, node long, print long, size long, bits array<long>"), "nodes")
    # The text of one row stands for its node.
    chosen = nodes.groupBy("node", "print").agg(F.min(F.struct("row", "mark", "size", "bits")).alias("least"))
    chosen = stored(chosen.select("node", "print", "least.*"), "chosen")
    packed = rows.mapInArrow(giving_back(_compressed), "row long, mark long, text binary")
    texts = stored(packed.join(chosen.select("row", "mark", "node"), ["row", "mark"]).dropDuplicates(["row", "mark"]).select("node", "text"), "texts")
    classes = _classed(chosen, _linked(chosen.select("node", "print", "size", "bits"), texts))
    least = classes.groupBy("class").agg(F.min(F.struct("row", "mark")).alias("least"))
    least = least.select(F.col("least.row").alias("_row"), F.col("least.mark").alias("_mark"))
    return keyed.join(least, ["_row", "_mark"], "left_semi").dropDuplicates(["_row", "_mark"]).select(*docs.columns)
