"""Best-two-fit packing of token sequences.

A sequence is filled greedily, longest piece first, then its smallest piece is
taken out again if two unpacked pieces fill the gap that this leaves more
tightly.

Pieces of one length are alike, so only the number of pieces of each length
decides. Those are at most ``capacity`` numbers, whatever the corpus. The plan
made from them is a list of sequence patterns with the number of times each is
used; a step uses its pattern as often as the pieces last, so every few steps
some length is used up and the plan stays as short as the list of lengths. The
pieces are then numbered within their length by Spark, without sorting a length
in one task, and each finds its pattern, sequence and offset by its number.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railwatch.llm.common import bounded_batches, numbers, raw
from railwatch.session import stored

CAPACITY = 2048
SEPARATOR = 0
WORD_CACHE = 600_000
# Pieces of one length are numbered in shares of about this many.
SHARE = 4096

_ID_BYTES = 4
# Punctuation that never joins what stands before it (the apostrophe may).
_MARKS = b".,;:!?%$&*#"
# Letters below this have plain lower-case forms.
_LATIN_END = "\u0250"


def _byte_symbols() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


_BYTE_SYMBOLS = _byte_symbols()
_tokenizers: dict[str, Tokenizer] = {}
_cache: dict[bytes, bytes] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _encoded(tokenizer: Tokenizer, text: bytes) -> bytes:
    return array("I", tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()


def _core_ids(tokenizer: Tokenizer, core: bytes) -> bytes:
    """Ids of a word without the punctuation behind it.

    A word of plain Latin letters is one pre-token, so it is lower-cased and
    handed to the model itself; anything else takes the whole tokenizer.
    """
    if not core.isalpha():
        lower = unicodedata.normalize("NFC", core.decode()).lower()
        if not (lower.isalpha() and max(lower) < _LATIN_END):
            return _encoded(tokenizer, core)
        core = lower.encode()
    symbols = core.lower().decode("latin-1").translate(_BYTE_SYMBOLS)
    return array("I", [t.id for t in tokenizer.model.tokenize(symbols)]).tobytes()


def _word_ids(tokenizer: Tokenizer, word: bytes) -> bytes:
    core = word.rstrip(_MARKS)
    if not core or (len(core) < len(word) and not core.decode()[-1].lower().isalnum()):
        return _encoded(tokenizer, word)
    ids, tail = _core_ids(tokenizer, core), word[len(core) :]
    if tail and tail not in _cache:
        _cache[tail] = _encoded(tokenizer, tail)
    return ids + _cache[tail] if tail else ids


def text_ids(tokenizer: Tokenizer, special: list[bytes], text: bytes) -> bytes:
    """Ids of a whole text, four bytes each.

    The tokenizer cuts at white space before anything else and drops it, so a
    text's ids are those of its words in a row. Texts that hold the string of a
    special token are encoded whole.
    """
    if any(s in text for s in special):
        return _encoded(tokenizer, text)
    words = text.split()
    found = list(map(_cache.get, words))
    if None in found:
        if len(_cache) > WORD_CACHE:
            _cache.clear()
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                if word not in _cache:
                    _cache[word] = _word_ids(tokenizer, word)
                found[i] = _cache[word]
    return b"".join(found)


def _pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                ids = memoryview(text_ids(tokenizer, special, text or b"") + end)
                total = len(ids) // _ID_BYTES
                for number, start in enumerate(range(0, total, capacity)):
                    stop = min(start + capacity, total)
                    rows.append((doc_id, number, start, stop - start, zlib.crc32(ids[start * _ID_BYTES : stop * _ID_BYTES])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and CRC of the ids of every piece of every document."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _fill(counts: np.ndarray, gap: int) -> list[int]:
    """Greedily the longest pieces that fit, without changing ``counts``."""
    taken: list[int] = []
    used: Counter[int] = Counter()
    longest = gap
    while gap > 0:
        fitting = np.flatnonzero(counts[1 : min(gap, longest) + 1])
        if not len(fitting):
            break
        longest = int(fitting[-1]) + 1
        copies = min(int(counts[longest]) - used[longest], gap // longest)
        taken += [longest] * copies
        used[longest] += copies
        gap -= copies * longest
        longest -= 1
    return taken


def _tighter_pair(counts: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """Two lengths that fill ``gap`` best, and by more than ``above``."""
    lengths = np.flatnonzero(counts[: gap + 1])
    if not len(lengths):
        return None
    padded = np.concatenate([[0], lengths])  # 0: no partner
    at = np.searchsorted(lengths, gap - lengths, "right")
    single = (padded[at] == lengths) & (counts[lengths] < 2)
    partner = padded[np.where(single, at - 1, at)]
    total = np.where(partner > 0, lengths + partner, 0)
    best = int(np.argmax(total))
    return (int(lengths[best]), int(partner[best])) if total[best] > above else None


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence's pieces) and how many sequences use each.

    ``counts[n]`` is the number of pieces of length n; the capacity is the last
    index.
    """
    counts, capacity, plan = counts.astype(np.int64).copy(), len(counts) - 1, []
    while counts.any():
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        pattern = [top, *_fill(counts, capacity - top)]
        for length in pattern[1:]:
            counts[length] -= 1
        gap = capacity - sum(pattern)
        if gap and len(pattern) > 1:
            pair = _tighter_pair(counts, gap + pattern[-1], pattern[-1])
            if pair:
                counts[pattern[-1]] += 1
                pattern[-1:] = pair
                counts[pair[0]] -= 1
                counts[pair[1]] -= 1
        need = Counter(pattern)
        more = min(int(counts[n]) // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * more
        plan.append((pattern, more + 1))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For every run of equal lengths in a pattern: which numbers of that length go where."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    names = ("length", "first", "copies", "sequence", "offset")
    return {n: np.array(c, np.int64) for n, c in zip(names, zip(*rows))} if rows else {n: np.empty(0, np.int64) for n in names}


def _placed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        # Runs of one length are sorted by their first number; both are packed into one key to search.
        keys = (slots["length"] << 48) + slots["first"]
        for batch in batches:
            length, number = numbers(batch.column("length")), numbers(batch.column("number"))
            at = np.searchsorted(keys, (length << 48) + number, "right") - 1
            inside = number - slots["first"][at]
            copies = slots["copies"][at]
            sequence = slots["sequence"][at] + inside // copies
            offset = slots["offset"][at] + inside % copies * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return run


def _numbered(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, in shares that are counted first."""
    sizes = counts.select("length", F.ceil(F.col("n") / SHARE).alias("shares"))
    place = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("share", F.pmod(place, F.col("shares"))).drop("shares")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    shares = shares.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece"))
    return dealt.join(shares, ["length", "share"]).withColumn("number", inside - 1 + F.col("before")).drop("share", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and give one piece, the separator alone. Documents
    longer than ``capacity`` are cut there; all others stay whole. Rows that
    share an id are packed each. Null ids are passed on; other columns are
    ignored. Sequences are numbered from 0.
    """
    pieces = stored(tokenized_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = stored(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    found = counts.collect()  # at most one row per length up to the capacity
    by_length = np.zeros(capacity + 1, np.int64)
    for row in found:
        by_length[row.length] = row.n
    shared = docs.sparkSession.sparkContext.broadcast(_slots(best_two_fit(by_length)))
    return _numbered(pieces, counts).mapInArrow(
        _placed(shared),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
