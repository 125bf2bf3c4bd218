"""Removal of repeated passages by sorting hashed windows in the order of a suffix tree's paths.

No tree is built: every window of fixed length is named by hashes and sorted
(prefix of 8 words, then the whole window), and equal neighbours are repeats.
The contract asks for repeats of one length only, so nodes at other depths are
not needed. In the terms of a tree:

A suffix starts at every word. Cut off at ``window`` words, the suffixes of all
documents form a tree whose inner nodes at full depth are the repeated
passages: the leaves below such a node are the places where the passage
starts, and all but the first of them are repeats.

1. Sieve. Every window holds a smallest run of ``GRAM`` words (by hash). Equal
   windows share it, so a window whose smallest run occurs once in the corpus
   cannot repeat and its suffix is a lone leaf that no tree needs. Only the
   smallest runs are shuffled, about one per seven words.
2. Groups. The remaining suffixes are dealt out by ranges of their path in the
   tree: the name of their first words, the name of all their words, then the
   place. Spark samples the paths and sets the range ends, so a frequent prefix
   is cut after more words and a rare one stays whole with its neighbours. Even
   a passage with any number of copies is split over several groups.
3. Trees. A group arrives in path order, so equal neighbours are leaves of one
   deep node and are read off in one pass that holds one batch. The first leaf
   of a group is settled against the last leaf of the groups before it.

Runs of words are named by 64-bit hashes that are doubled in length step by
step; a full path has 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.llm.common import bounded_batches, giving_back, id_order, numbers, raw, schema_of, text_mark, texts
from railwatch.session import stored

WINDOW = 20
GRAM = 8
# Ranges are cut by runs of words from about so many documents, and by so many runs at most.
# They only decide which task sorts what.
RANGE_DOCUMENTS = 4096
RANGE_ROWS = 50_000

# ``mark``, a hash of the text, tells rows that share an id apart; a place is a word offset.
_PATH = ("prefix", "whole", "row", "mark", "place")
_PATH_KINDS = ", ".join(f"{c} long" for c in _PATH)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_names(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of every run of ``length`` words, built from names of runs of doubling length."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    named, covered, level, span = None, 0, words, 1
    while True:
        if length & span:
            if named is None:
                named = level
            else:
                shared = min(len(named), len(level) - covered)
                named = _mixed(named[:shared] * np.uint64(31) + level[covered : covered + shared])
            covered += span
        if covered == length:
            return named[:count]
        level = _mixed(level[:-span] * np.uint64(37) + level[span:])
        span *= 2


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def _window_minima(words: np.ndarray, window: int) -> np.ndarray:
    gram = min(GRAM, window)
    return _smallest(run_names(words, gram), window - gram + 1)


def _sieve_rows(words: np.ndarray, window: int) -> np.ndarray:
    """The smallest runs of a text's windows, twice if the text has the run twice."""
    found = np.unique(_window_minima(words, window))
    runs, times = np.unique(run_names(words, min(GRAM, window)), return_counts=True)
    return np.repeat(found, np.minimum(times[np.searchsorted(runs, found)], 2))


def _sieve_keys(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, marks = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row, mark, text in zip(numbers(batch.column("row")), numbers(batch.column("mark")), raw(batch.column("text"))):
                words = (text or b"").split()
                if len(words) >= window:
                    found = _sieve_rows(word_hashes(words), window)
                    keys.append(found)
                    owners.append(np.full(len(found), row, np.int64))
                    marks.append(np.full(len(found), mark, np.int64))
            arrays = [np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(marks)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gram", "row", "mark"])

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, those whose gram has a neighbour; first and last of a task count as such.

    What neighbouring tasks hold is not known here. Keeping a gram too many
    only lets a few more suffixes through.
    """
    names, held = ["gram", "row", "mark"], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.column_stack([numbers(batch.column(n)) for n in names])
        if held is not None:
            rows = np.vstack([held[0], rows])
        gram = rows[:, 0]
        same = gram[1:] == gram[:-1]
        keep = np.zeros(len(gram), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] = True  # the first row of a task, or one carried over and already known to be kept or lone
        if held is not None and not held[1]:
            keep[0] = same[0] if len(same) else False
        kept = rows[:-1][keep[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(3)], names)
        held = (rows[-1:], bool(keep[-1]))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0][:, i]) for i in range(3)], names)


def _suffixes(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Path and place of every suffix that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            columns = (numbers(batch.column("row")), numbers(batch.column("mark")), _expanded(batch.column("text")))
            for row, mark, text, grams in zip(*columns, batch.column("grams")):
                hashes = word_hashes(text.split())
                if len(hashes) < window:
                    continue
                shared = numbers(grams.values).view(np.uint64)
                at = np.flatnonzero(np.isin(_window_minima(hashes, window), shared))
                if not len(at):
                    continue
                prefix, whole = run_names(hashes, min(GRAM, window))[at], run_names(hashes, window)[at]
                owner = (np.full(len(at), row, np.int64), np.full(len(at), mark, np.int64))
                parts.append((prefix.view(np.int64), whole.view(np.int64), *owner, at))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], list(_PATH))

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf of a deep node of this group but the node's first; then the first and last leaf of the group.

    The latter come with the group's number and their path, so that nodes which
    began in an earlier group are told.
    """
    number, first, head = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        paths = np.column_stack([numbers(batch.column(c)) for c in _PATH])
        head = paths[0] if head is None else head
        last = paths[-1]
        if first is not None:
            paths = np.vstack([first, paths])
        opens = np.ones(len(paths), bool)
        opens[1:] = (paths[1:, :2] != paths[:-1, :2]).any(axis=1)
        leader = np.maximum.accumulate(np.where(opens, np.arange(len(paths)), 0))
        later = (paths[:, 2:] != paths[leader, 2:]).any(axis=1)
        yield _leaf_rows(paths[later], None, None)
        first = paths[leader[-1]]
    if head is not None:
        yield _leaf_rows(head[None], number, True)
        yield _leaf_rows(last[None], number, False)


def _leaf_rows(paths: np.ndarray, number: int | None, head: bool | None) -> pa.RecordBatch:
    count = len(paths)
    known = [pa.array(paths[:, i]) if number is not None else pa.nulls(count, pa.int64()) for i in (0, 1)]
    arrays = [pa.array([number] * count, pa.int32()), pa.array([head] * count, pa.bool_()), *known]
    arrays += [pa.array(paths[:, i]) for i in (2, 3, 4)]
    return pa.RecordBatch.from_arrays(arrays, ["number", "head", *_PATH])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([t and compress(t) for t in raw(batch.column("text"))], pa.binary())
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", packed)


def _expanded(packed: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return (expand(p) if p else b"" for p in packed.to_pylist())


def _without(window: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the windows at ``places`` out of each text; null where nothing is cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, kept, sizes, removed = [], [], [], []
            there = batch.column("text").is_valid().to_pylist()
            for text, known, places in zip(_expanded(batch.column("text")), there, batch.column("places")):
                words = text.split()
                whole.append(text if known else None)
                sizes.append(len(words))
                starts = numbers(places.values) if places.is_valid else np.empty(0, np.int64)
                if len(starts):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
            made = {
                "text": texts(whole),
                "kept": texts(kept),
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
            }
            arrays = [made[n] if n in made else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _range_of(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending bounds are not above each row, comparing column by column."""
    at = np.searchsorted(bounds[:, 0], rows[:, 0], side="right")
    # Rows that agree with a bound in the first column are few, unless a run of words is very frequent.
    tied = np.flatnonzero(np.searchsorted(bounds[:, 0], rows[:, 0], side="left") < at)
    if len(tied):
        both = np.vstack([bounds, rows[tied]])
        is_row = np.arange(len(both)) >= len(bounds)
        order = np.lexsort((is_row, *both.T[::-1]))
        below = np.cumsum(~is_row[order])
        at[tied[order[is_row[order]] - len(bounds)]] = below[is_row[order]]
    return at


def _with_range(function: Callable, columns: tuple[str, ...], shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of ``function`` with the number of the range they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            rows = np.column_stack([numbers(batch.column(c)) for c in columns])
            parts = _range_of(rows, shared.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts)], [*batch.schema.names, "part"])

    return run


def _in_ranges(docs: DataFrame, some: DataFrame, function: Callable, columns: tuple[str, ...]) -> DataFrame:
    """The rows that ``function`` makes of the documents, sorted, each range of them in a task of its own.

    Ranges are cut by what ``some`` of the documents give, so only those go through
    ``function`` twice; a frequent run of words falls into as many ranges as it fills.
    """
    spark = docs.sparkSession
    kinds = ", ".join(f"{c} long" for c in columns)
    drawn = some.mapInArrow(function, kinds).orderBy(F.xxhash64(*columns)).limit(RANGE_ROWS).collect()
    found = np.array(sorted(tuple(r) for r in drawn), np.int64).reshape(-1, len(columns))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.linspace(0, len(found), parts + 1)[1:-1].astype(int)
    shared = spark.sparkContext.broadcast(np.unique(found[cuts], axis=0) if len(found) else found)
    rows = docs.mapInArrow(giving_back(_with_range(function, columns, shared)), f"{kinds}, part int")
    return rows.repartitionById(parts, "part").drop("part").sortWithinPartitions(*columns)


def _repeat_places(packed: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """row, mark, places: the starts of all windows that also start earlier."""
    one_in = F.lit(max(1, docs.count() // RANGE_DOCUMENTS))
    some = F.pmod(F.xxhash64("row", "mark"), one_in) == 0
    grams = (
        _in_ranges(docs, docs.filter(some), _sieve_keys(window), ("gram", "row", "mark"))
        .mapInArrow(giving_back(_shared_keys), "gram long, row long, mark long")
    )
    shared = stored(grams.groupBy("row", "mark").agg(F.collect_set("gram").alias("grams")), "shared")
    sifted = packed.join(shared, ["row", "mark"])
    leaves = stored(
        _in_ranges(sifted, packed.filter(some).join(shared, ["row", "mark"]), _suffixes(window), _PATH)
        .mapInArrow(_leaves, f"number int, head boolean, {_PATH_KINDS}"),
        "leaves",
    )
    ends = leaves.filter("not head").select(*(F.col(c).alias(f"end_{c}") for c in ("number", *_PATH)))
    continued = leaves.filter("head").join(
        ends,
        (F.col("prefix") == F.col("end_prefix"))
        & (F.col("whole") == F.col("end_whole"))
        & (F.col("end_number") < F.col("number"))
        & ~((F.col("row") == F.col("end_row")) & (F.col("mark") == F.col("end_mark")) & (F.col("place") == F.col("end_place"))),
        "left_semi",
    )
    where = ["row", "mark", "place"]
    repeats = leaves.filter("head is null").select(*where).unionByName(continued.select(*where))
    return repeats.groupBy("row", "mark").agg(F.collect_set("place").alias("places"))


def _cut(docs: DataFrame, window: int, carried: list[str], made: list[str]) -> DataFrame:
    """``carried`` columns of every row, which go along as they are, and those ``made`` of its text."""
    bounded_batches(docs)
    along = F.struct(*carried).alias("along")
    keyed = docs.select(along, id_order().alias("row"), text_mark().alias("mark"), "text")
    # Texts are shuffled twice, so they are compressed for it.
    kinds = f"{schema_of(keyed, 'along', 'row', 'mark')}, text binary"
    packed = keyed.mapInArrow(giving_back(_compressed), kinds)
    places = _repeat_places(packed.drop("along"), keyed.select("row", "mark", "text"), window)
    types = {"text": "string", "kept": "string", "n_words": "long", "n_removed": "long"}
    kinds = ", ".join([schema_of(keyed, "along"), *(f"{n} {types[n]}" for n in made)])
    return packed.join(places, ["row", "mark"], "left").mapInArrow(giving_back(_without(window, ["along", *made])), kinds).select("along.*", *made)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, kept (text), n_words, n_removed.

    A word goes if a run of ``window`` words covers it that also starts earlier:
    in a document with a smaller id, or earlier in the same one. All runs are
    judged on the input. Kept words are joined by one space.

    A null id sorts before all others; a null text has no words; texts shorter
    than ``window`` words are kept. Rows that share an id keep their own result
    each: equal rows do not repeat each other, different texts under one id go
    in the order of a hash of their text. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(docs, window, ["doc_id"], ["kept", "n_words", "n_removed"])


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, repeats cut out of ``text`` and ``n_chars`` set anew.

    Texts without repeats stay as they are; documents that lose every word go.
    """
    carried = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = _cut(docs, window, carried, ["text", "kept", "n_words", "n_removed"])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    left = cut.filter("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
