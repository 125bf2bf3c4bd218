"""Byte-level BPE by a rank queue: encoding texts into token ids and decoding them.

A text is cut by a pattern and each pre-token is encoded by itself: it starts as
single bytes, and the adjacent pair of lowest rank, the leftmost of equal ones,
is merged until no pair has a rank. Looking for that pair anew after each merge
takes quadratic time on a long pre-token. Here the symbols form a linked list,
and a queue holds the pairs:

* one bucket per merge rank holds the places of its pairs, sorted when its turn comes;
* a bitmap marks the buckets that hold something, 64 to a word, and two smaller
  bitmaps mark the words that are not zero, so the lowest rank is found by three
  find-first-set operations;
* a merge changes the pairs on both sides. Their old entries stay where they are
  and are skipped when met, because the rank kept at their place has changed.

So a pre-token of n bytes takes n merges at most, each at a cost that does not
depend on n but for the sorting of its bucket. Many pre-tokens share one queue,
laid out side by side. Ids of short ones are kept in a worker's cache, bounded
by its entries and by the length of each.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.llm.common import bounded_batches

# The young cache holds pre-tokens up to this many characters, and starts anew at this many entries, with the last ones behind it.
CACHED_CHARACTERS = 48
CACHE_ENTRIES = 400_000

# Texts are encoded in steps of so many characters, ids decoded in steps of so many.
STEP = 1 << 18

ID = np.dtype("<u4")


class Ranks:
    """A vocabulary of byte strings with their ranks, which are the token ids."""

    def __init__(self, pairs: list[tuple[bytes, int]]):
        self.rank = dict(pairs)
        self.size = max(self.rank.values(), default=-1) + 1
        self.token: list[bytes | None] = [None] * self.size
        for token, rank in pairs:
            self.token[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the vocabulary has no token for {len(missing)} of the 256 bytes")
        self.of_one = np.array([self.rank[bytes([b])] for b in range(256)])
        self.of_two = np.full(1 << 16, -1)
        for token, rank in pairs:
            if len(token) == 2:
                self.of_two[token[0] << 8 | token[1]] = rank


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    """Read a rank file: per line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return Ranks([(base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in lines if line.strip())])


class RankQueue:
    """Places in buckets by rank; ``pop`` takes the bucket of lowest rank."""

    def __init__(self, size: int):
        words = -(-size // 64)
        self.words, self.groups, self.top = [0] * words, [0] * -(-words // 64), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, places: list[int]) -> None:
        """Mark a bucket that is empty so far."""
        self.buckets[rank] = places
        word = rank >> 6
        self.words[word] |= 1 << (rank & 63)
        self.groups[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its places from left to right."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.words[word] = bits & (bits - 1)
        if not self.words[word]:
            self.groups[group] ^= 1 << (word & 63)
            if not self.groups[group]:
                self.top ^= 1 << group
        places = self.buckets.pop(rank)
        places.sort()
        return rank, places


def merge_all(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Packed ids of each of many pre-tokens.

    They lie in one row of bytes with no pairs across their edges and share a
    queue. A merge cannot make another pair of its own rank, since that would be
    longer; where it makes one of a lower rank, the rest of the bucket waits.
    """
    if not pieces:
        return []
    row = b"".join(pieces)
    n = len(row)
    stops = np.cumsum([len(p) for p in pieces])
    codes = np.frombuffer(row, np.uint8).astype(np.int64)
    first = np.full(n, -1)
    first[:-1] = ranks.of_two[codes[:-1] << 8 | codes[1:]]
    first[stops[stops > 0] - 1] = -1
    queue = RankQueue(ranks.size)
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0) :]
    cuts = [0, *(np.flatnonzero(np.diff(first[order])) + 1).tolist(), len(order)] if len(order) else [0]
    heads, places = first[order[cuts[:-1]]].tolist(), order.tolist()
    for rank, a, b in zip(heads, cuts, cuts[1:]):
        queue.push(rank, places[a:b])
    # A symbol is a span from its start to ``end``; ``pair`` is the rank of a span joined with the next one, -1 for none.
    pair, token = first.tolist(), ranks.of_one[codes].tolist()
    end, before = list(range(1, n + 1)), np.arange(-1, n - 1)
    lengths = np.diff(stops, prepend=0)
    before[(stops - lengths)[lengths > 0]] = -1
    before, last = before.tolist(), np.repeat(stops, lengths).tolist()
    rank_of, buckets, gone = ranks.rank.get, queue.buckets, []
    while (found := queue.pop()) is not None:
        rank, places = found
        lower = False
        for number, at in enumerate(places):
            if pair[at] != rank:
                continue
            second = end[at]
            stop = end[second]
            end[at], token[at], pair[second] = stop, rank, -1
            gone.append(second)
            if stop < last[at]:
                before[stop] = at
                joined = pair[at] = rank_of(row[at : end[stop]], -1)
                if joined >= 0:
                    if joined in buckets:
                        buckets[joined].append(at)
                    else:
                        queue.push(joined, [at])
                    lower = joined < rank
            else:
                pair[at] = -1
            left = before[at]
            if left >= 0:
                joined = pair[left] = rank_of(row[left:stop], -1)
                if joined >= 0:
                    if joined in buckets:
                        buckets[joined].append(left)
                    else:
                        queue.push(joined, [left])
                    lower = lower or joined < rank
            if lower:
                if number + 1 < len(places):
                    queue.push(rank, places[number + 1 :])
                break
    alive = np.ones(n, bool)
    alive[gone] = False
    ids = np.array(token, ID)[alive].tobytes()
    cuts = np.cumsum(alive)[np.maximum(stops, 1) - 1] * ID.itemsize if n else np.zeros(len(stops), int)
    cuts = [0, *np.where(stops > 0, cuts, 0).tolist()]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Encodes texts with a cache of the ids of short pre-tokens, packed as little-endian unsigned 32-bit integers.

    The cache is two dictionaries: when the young one is full it becomes the old
    one, whose entries move up again when they are met. So rare pre-tokens leave
    and frequent ones stay.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that the young cache lacks; those that the old one lacks too are merged together."""
        packed = {p: i for p, i in zip(new, map(self.old.get, new)) if i is not None}
        rest = [p for p in new if p not in packed]
        whole = [self.ranks.rank.get(p.encode()) for p in rest]
        packed.update((p, np.array([r], ID).tobytes()) for p, r in zip(rest, whole) if r is not None)
        rest = [p for p, r in zip(rest, whole) if r is None]
        packed.update(zip(rest, merge_all([p.encode() for p in rest], self.ranks)))
        short = {p: i for p, i in packed.items() if len(p) <= CACHED_CHARACTERS}
        if len(self.young) + len(short) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        self.young.update(short)
        return packed

    def _step(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of several lists of pre-tokens."""
        known = self.young
        found = [list(map(known.get, p)) for p in pieces]
        lacking = [n for n, f in enumerate(found) if None in f]
        if lacking:
            packed = self._learn(list({p for n in lacking for p, f in zip(pieces[n], found[n]) if f is None}))
            for n in lacking:
                found[n] = [packed[p] if f is None else f for p, f in zip(pieces[n], found[n])]
        return list(map(b"".join, found))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Short texts go together, long ones in parts, so a step is never much longer than ``STEP``."""
        out: list[bytes] = []
        waiting, size = [], 0
        for text in texts:
            if size + len(text) > STEP and waiting:
                out += self._step(waiting)
                waiting, size = [], 0
            if len(text) > STEP:
                out.append(self._long(text))
            else:
                waiting.append(self.pattern.findall(text))
                size += len(text)
        return out + self._step(waiting)

    def _long(self, text: str) -> bytes:
        parts, pieces, at = [], [], 0
        for match in self.pattern.finditer(text):
            pieces.append(match.group())
            if match.end() - at > STEP:
                parts += self._step([pieces])
                pieces, at = [], match.end()
        return b"".join(parts + self._step([pieces]))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, whose cache outlives a task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def decoded(ids: bytes, ranks: Ranks) -> bytes:
    """Bytes of packed ids."""
    numbers = np.frombuffer(ids, ID)
    if len(numbers) and int(numbers.max()) >= ranks.size:
        raise ValueError(f"id {int(numbers.max())} is not in the vocabulary")
    token = ranks.token.__getitem__
    parts = [b"".join(map(token, numbers[at : at + STEP].tolist())) for at in range(0, len(numbers), STEP)]
    return b"".join(parts)


def _encoding(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_all
        for batch in batches:
            ids = encode([text or "" for text in batch.column("text").to_pylist()])
            arrays = [batch.column("doc_id"), pa.array([len(i) // ID.itemsize for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids"])

    return run


def _decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            found = [None if ids is None else decoded(ids, ranks) for ids in batch.column("ids").to_pylist()]
            kept = [batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids.

    ``ids`` is a binary of little-endian unsigned 32-bit token ids, the form that
    training files hold. Every match of ``pattern`` in the whole text is encoded by
    itself, without special tokens; their strings are ordinary text. Characters
    that no match covers have no ids.

    Null and empty texts have no ids: 0 tokens, an empty binary. Repeated rows are
    encoded each; null ids are passed on. Equal ranks in a pre-token are merged from
    the left. Other columns are ignored. An empty table gives an empty table.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoding(ranks_path, pattern), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes that the packed ``ids`` of each row stand for; null for null ids.

    Of other columns only doc_id and n_tokens are kept. An id outside the vocabulary is an error.
    """
    rows = bounded_batches(encoded).select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(_decoding(ranks_path), "doc_id long, n_tokens long, ids binary, decoded binary")
