"""Ranked lexical search with Block-Max MaxScore.

Documents are dealt over shards of bounded size, each with an inverted index of
the terms that the queries ask for. A list of postings is kept in blocks: the
block's first document, 16- or 32-bit offsets from it, and the block's largest
impact (what an occurrence is worth before the term's weight).

A query goes over its lists in windows of documents. Its lists are sorted by
their bound, weight times largest impact. The weakest lists, whose bounds together
cannot lift a document above the k-th best score so far, are not essential:
only documents of the other, essential lists are candidates. For the lists that
are not essential, a candidate meets the maxima of the blocks it would lie in
first, and is rejected by them before a block is decompressed. The lists that
are left are looked up from the strongest on, with a check after each.

Within a shard documents are numbered by id, so a later one of equal score never
displaces an earlier one, and every score of more than the k-th best is whole.
The k best of all shards are merged to the k best of all.

All arithmetic but the logarithm of a weight is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railwatch.llm.common import NO_ID, bounded_batches, id_order, raw
from railwatch.session import stored

TOP = 50
# Postings to a block.
BLOCK = 128
# Documents to a window, which ends when that many have been looked at; the first is smaller, to find a threshold early.
WINDOW, FIRST_WINDOW = 4096, 512
# Postings to a shard, and terms of queries that go to it at a time.
SHARD_POSTINGS = 1 << 19
BLOCK_TERMS = 1 << 18
# Terms of queries that are broadcast, in bytes; if there are more, postings meet them by a join.
BROADCAST_BYTES = 32 << 20
# Texts are counted in steps of this many bytes.
STEP = 8 << 20

# Terms are runs of ASCII letters, digits and all that is not ASCII; only A-Z become small.
_SMALL = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """Occurrences of every term of a text."""
    plain = text.translate(_SMALL)
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(plain):
        stop = plain.find(b" ", at + STEP)
        stop = len(plain) if stop < 0 else stop
        counts.update(plain[at:stop].split())
        at = stop
    return counts


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [[t.decode() for t in term_counts(text or b"")] for text in raw(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(terms, pa.list_(pa.string()))], ["query", "terms"])


def _counted(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document with a term: its number, id, terms with repeats, and the counts of known terms (of all, if none are given)."""
    kind = pa.string() if known is None else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            columns = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                counts = term_counts(text or b"")
                number += 1
                if not counts:
                    continue
                if known is None:
                    held = [(t.decode(), n) for t, n in counts.items()]
                else:
                    held = [(k, n) for k, n in zip(map(known.value.get, counts), counts.values()) if k is not None]
                values = number, doc_id, counts.total(), [k for k, _ in held], [n for _, n in held]
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["number", "doc_id", "n", "terms", "counts"])

    return run


def count_terms(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """number, doc_id, n, and the terms (by their number in ``vocabulary``) and counts of every document with a term, stored."""
    rows = bounded_batches(docs).select(id_order().alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    schema = "number long, doc_id long, n long, terms array<{}>, counts array<long>"
    if size <= BROADCAST_BYTES:
        known = docs.sparkSession.sparkContext.broadcast({r.text.encode(): r.term for r in vocabulary.collect()})
        return stored(rows.mapInArrow(_counted(known), schema.format("int")), "counted")
    every = stored(rows.mapInArrow(_counted(None), schema.format("string")), "counted")
    postings = every.select("number", F.explode(F.arrays_zip(F.col("terms").alias("text"), F.col("counts").alias("count"))).alias("p"))
    met = postings.select("number", "p.text", "p.count").join(vocabulary, "text").groupBy("number")
    met = met.agg(F.collect_list(F.struct("term", "count")).alias("held"))  # one document's own terms
    whole = every.select("number", "doc_id", "n").join(met, "number", "left")
    none = F.array().cast("array<int>"), F.array().cast("array<long>")
    terms, counts = F.coalesce("held.term", none[0]), F.coalesce("held.count", none[1])
    return stored(whole.select("number", "doc_id", "n", terms.alias("terms"), counts.alias("counts")), "met")


class Postings:
    """One term's documents in a shard, in blocks: first document, offsets from it, impacts and the largest of them."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        blocks = -(-len(docs) // BLOCK)
        pad = blocks * BLOCK - len(docs)
        # Padding repeats the last document; it is cut off by ``size``.
        padded = np.concatenate([docs, np.repeat(docs[-1:], pad)]).reshape(blocks, BLOCK)
        self.size = len(docs)
        self.first, self.last = padded[:, 0].copy(), padded[:, -1].copy()
        offsets = padded - self.first[:, None]
        self.offsets = offsets.astype(np.uint16 if offsets.max() < 1 << 16 else np.uint32)
        self.impacts = np.concatenate([impacts, np.zeros(pad, impacts.dtype)]).reshape(blocks, BLOCK)
        self.maxima = self.impacts.max(axis=1).astype(np.int64)
        self.most = int(self.maxima.max())

    def within(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts from ``low`` up to ``high``, of the blocks that reach into that range."""
        a, b = int(np.searchsorted(self.last, low)), int(np.searchsorted(self.first, high))
        docs = (self.first[a:b, None] + self.offsets[a:b]).ravel()[: self.size - a * BLOCK]
        x, y = np.searchsorted(docs, (low, high))
        return docs[x:y], self.impacts[a:b].ravel()[x:y]

    def block_maxima(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block each of some ascending documents would lie in, and its maximum; 0 between blocks and beyond the last."""
        block = np.searchsorted(self.last, docs)
        inside = np.minimum(block, len(self.last) - 1)
        held = (block < len(self.last)) & (self.first[inside] <= docs)
        return inside, np.where(held, self.maxima[inside], 0)

    def impacts_of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of ascending documents that lie in these blocks; only those blocks are decompressed."""
        used, turn = np.unique(block, return_inverse=True)
        held = (self.first[used, None] + self.offsets[used]).ravel()
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        # Padding repeats a document behind its own place, so the place found is the real one.
        return np.where(held[at] == docs, self.impacts[used].ravel()[at], 0).astype(np.int64)


def search(lists: list[tuple[int, Postings]], size: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` best of ``size`` documents by the sum of weight times impact: documents and scores above 0, best first."""
    lists = sorted((x for x in lists if x[0] * x[1].most > 0), key=lambda x: x[0] * x[1].most)
    bounds = np.cumsum([w * p.most for w, p in lists])
    best, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    low, width = 0, FIRST_WINDOW
    while low < size:
        high = min(size, low + width)
        weak = int(np.searchsorted(bounds, threshold, side="right"))
        if weak == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for weight, postings in lists[weak:]:
            docs, impacts = postings.within(low, high)
            sums[docs - low] += weight * impacts.astype(np.int64)
        docs = np.flatnonzero(sums)
        got = sums[docs]
        docs += low
        if weak:
            docs, got = _lifted(lists[:weak], docs, got, int(bounds[weak - 1]), threshold)
        if len(docs):
            keep = got > threshold
            best, scores = np.concatenate([best, docs[keep]]), np.concatenate([scores, got[keep]])
            order = np.lexsort((best, -scores))[:top]
            best, scores = best[order], scores[order]
            threshold = int(scores[-1]) if len(scores) == top else 0
        low, width = high, WINDOW
    return best, scores


def _lifted(weak: list[tuple[int, Postings]], docs: np.ndarray, got: np.ndarray, bound: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates with what the lists that are not essential add; those that cannot pass the threshold are left out."""
    keep = got + bound > threshold
    docs, got = docs[keep], got[keep]
    if not len(docs):
        return docs, got
    found = [p.block_maxima(docs) for _, p in weak]
    blocks, maxima = np.array([b for b, _ in found]), np.array([w * m for (w, _), (_, m) in zip(weak, found)])
    rest = maxima.sum(axis=0)
    for number in range(len(weak) - 1, -1, -1):
        keep = got + rest > threshold
        if not keep.all():
            docs, got, rest, blocks, maxima = docs[keep], got[keep], rest[keep], blocks[:, keep], maxima[:, keep]
        if not len(docs):
            break
        weight, postings = weak[number]
        asked = np.flatnonzero(maxima[number])
        if len(asked):
            got[asked] += weight * postings.impacts_of(docs[asked], blocks[number, asked])
        rest = rest - maxima[number]
    return docs, got


def _index(shard: pd.DataFrame) -> tuple[dict[int, Postings], np.ndarray]:
    """Lists by term, and the ids of a shard's documents, which are numbered in their order."""
    shard = shard.sort_values("doc_id", kind="stable")
    sizes = shard["terms"].map(len).to_numpy()
    docs = np.repeat(np.arange(len(shard)), sizes)
    term, tf = (np.concatenate(shard[c].to_numpy()).astype(np.int64) for c in ("terms", "counts"))
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * shard["m"].to_numpy()[docs])
    place = np.argsort(term, kind="stable")
    parts = np.split(place, np.flatnonzero(np.diff(term[place])) + 1)
    return {int(term[p[0]]): Postings(docs[p], impact[p].astype(np.uint32)) for p in parts}, shard["doc_id"].to_numpy()


def _answered(top: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(shard: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        parts = [[], [], []]
        if len(shard) and len(items):
            lists, ids = _index(shard)
            for query, terms, weights in zip(items["query"], items["terms"], items["weights"]):
                asked = [(int(w), lists[t]) for t, w in zip(terms, weights) if t in lists]
                docs, scores = search(asked, len(ids), top)
                for part, values in zip(parts, (np.full(len(docs), query), ids[docs], scores)):
                    part.append(values)
        none = np.zeros(0, np.int64)
        return pd.DataFrame({c: np.concatenate([none, *p]) for c, p in zip(("query", "doc_id", "score"), parts)})

    return run


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of every item: item_id, rank (from 1), doc_id, score.

    An item asks for each of its different terms once. Scores are those of the
    contract: per term floor(1000 ln((2N+2)/(2df+1))) times its impact in the
    document. Only scores above 0 are listed; equal ones by ascending id, rows
    with a null id first.

    Null and empty texts have no terms: such documents are never found and count
    nowhere, such items have no rows. Rows of documents that share an id are
    documents each; items that share an id (null being one) ask together. Other
    columns are ignored. Empty tables give an empty table.
    """
    rows = bounded_batches(items).select(id_order("item_id").alias("query"), F.col("text").cast("string").alias("text"))
    terms = rows.mapInArrow(_terms_of, "query long, terms array<string>")
    asked = stored(terms.select("query", F.explode("terms").alias("text")).distinct(), "asked")
    # Terms are numbered within 256 slices, so that no task numbers all.
    words = asked.select("text").distinct().withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(256)))
    at = F.row_number().over(Window.partitionBy("slice").orderBy("text"))
    vocabulary = stored(words.select("text", (at * 256 + F.col("slice")).cast("int").alias("term")), "vocabulary")
    counted = count_terms(docs, vocabulary)
    sums = counted.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms").cast("long")).alias("postings")).first()
    if not sums.postings:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * sums.N + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    weighed = vocabulary.join(held, "term").select("text", "term", weight)
    grouped = asked.join(weighed, "text").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("w"))
    queries = stored(grouped.select("query", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights")), "queries")
    shards, blocks = -(-sums.postings // SHARD_POSTINGS), max(1, -(-asked.count() // BLOCK_TERMS))
    norm = F.expr(f"50L + (50L * n * {sums.N}L) div {sums.L}L").alias("m")
    shard, block = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("number", shards), ("query", blocks)))
    all_shards, all_blocks = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (shards, blocks))
    dealt = counted.filter(F.size("terms") > 0).select("doc_id", norm, "terms", "counts", shard.alias("shard"), all_blocks.alias("block"))
    sent = queries.select("query", "terms", "weights", all_shards.alias("shard"), block.alias("block"))
    keys = ["shard", "block"]
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_answered(top), "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    item_id, doc_id = (F.nullif(F.col(c), F.lit(NO_ID)) for c in ("query", "doc_id"))
    return best.select(item_id.alias("item_id"), "rank", doc_id.alias("doc_id"), "score")
