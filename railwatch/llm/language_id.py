"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (by
product) the vectors of its letters, permuted once per place; a text's vector
bundles (sums) those of its trigrams, and a language's prototype bundles its
documents. A document is compared with the prototypes by cosine.

Bundling is linear, so the product of a document with a prototype is the sum of
the products of its trigrams with the prototype. There are few trigrams over
the letter classes, so these products are tabulated once per language, and a
document costs one lookup per letter instead of one vector. Vectors of
different trigrams are as good as orthogonal, which gives a document's length
from its trigram counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.llm.common import bounded_batches, held_out

DIMENSIONS = 1024
CLASSES = 64
UNKNOWN = "und"
SEED = 11

_TRIGRAMS = CLASSES**3
_AT_ONCE = 1 << 18


def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], np.float32), (CLASSES, DIMENSIONS))


def _letter_class(char: str) -> int:
    """0 for anything but letters; a to z have classes of their own, other letters share the rest."""
    lower = char.lower()[0]
    if not lower.isalpha():
        return 0
    if "a" <= lower <= "z":
        return 1 + ord(lower) - ord("a")
    return 27 + zlib.crc32(lower.encode()) % (CLASSES - 27)


class _Classes:
    """Letter classes of code points, worked out as they are met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found < 0).any():
            for point in np.unique(points[found < 0]):
                self.table[point] = _letter_class(chr(point))
            found = self.table[points]
        return found


_classes: list[_Classes] = []


def _known() -> _Classes:
    if not _classes:
        _classes.append(_Classes())
    return _classes[0]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Trigram numbers of a text, in parts; runs of other characters count as one space, also at both ends."""
    known, carried = _known(), np.zeros(1, np.int32)
    for at in range(0, len(text), _AT_ONCE):
        part = text[at : at + _AT_ONCE]
        letters = known.of(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int32)
        if at + _AT_ONCE >= len(text):
            letters = np.append(letters, np.int32(0))
        letters = np.concatenate([carried, letters])
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
        letters = letters[keep]
        if len(letters) > 2:
            yield (letters[:-2] * CLASSES + letters[1:-1]) * CLASSES + letters[2:]
        carried = letters[-2:]


def _counted(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of all parts of a text, and how often each occurs in the whole."""
    kinds, times = np.empty(0, np.int32), np.empty(0, np.int64)
    for part in parts:
        found, n = np.unique(part, return_counts=True)
        if len(kinds):
            found, at = np.unique(np.concatenate([kinds, found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([times, n])).astype(np.int64)
        kinds, times = found, n
    return kinds, times


def _bundled(counts: np.ndarray) -> np.ndarray:
    """Sum of the vectors of all trigrams, each as often as it counts."""
    vectors = _letter_vectors()
    cube = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float32)
    last = cube.reshape(-1, CLASSES) @ vectors
    middle = np.roll(vectors, 1, axis=1)
    pairs = (last.reshape(CLASSES, CLASSES, DIMENSIONS) * middle).sum(axis=1)
    return (pairs * np.roll(vectors, 2, axis=1)).sum(axis=0, dtype=np.float64)


def _products(prototype: np.ndarray) -> np.ndarray:
    """Product of every trigram's vector with a prototype."""
    vectors = _letter_vectors()
    first = np.roll(vectors, 2, axis=1) * prototype.astype(np.float32)
    pairs = first[:, None, :] * np.roll(vectors, 1, axis=1)
    return (pairs.reshape(-1, DIMENSIONS) @ vectors.T).reshape(-1)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundled vector of each language in a task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in counts:
                counts[lang] = np.zeros(_TRIGRAMS, np.int64)
            for found in trigrams(text):
                np.add.at(counts[lang], found, 1)
    for lang, found in counts.items():
        vector = _bundled(found)
        places = np.arange(DIMENSIONS)
        names = ["lang", "place", "value"]
        arrays = [pa.array([lang] * DIMENSIONS, pa.string()), pa.array(places, pa.int32()), pa.array(vector)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def prototypes(docs: DataFrame) -> DataFrame:
    """lang, vector: one row per language, bundled from ``docs(lang, text)``."""
    rows = bounded_batches(docs).filter("lang is not null and text is not null").select("lang", "text")
    summed = rows.mapInArrow(_profiles, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    return summed.groupBy("lang").agg(ordered.alias("vector"))


def _predicted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vectors = shared.value
        table = np.empty((_TRIGRAMS, len(langs)), np.float32)
        for i, vector in enumerate(vectors):
            length = np.linalg.norm(vector)
            table[:, i] = _products(vector / length) if length else 0.0
        for batch in batches:
            best, scores = [], []
            for text in batch.column("text").to_pylist():
                kinds, times = _counted(trigrams(text or ""))
                products, square = times @ table[kinds], int(times @ times)
                lettered = square and any(c.isalpha() for c in text)
                if lettered and langs:
                    cosines = products / np.sqrt(float(DIMENSIONS) * square)
                    at = int(np.argmax(cosines))
                    best.append(langs[at])
                    scores.append(float(np.clip(cosines[at], 0.0, 1.0)))
                else:
                    best.append(UNKNOWN)
                    scores.append(0.0)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Prototypes are bundled from all documents that are not held out and have a
    language. ``lang_pred`` is the language of the largest cosine (ties: the
    first by name) and ``score`` that cosine, cut to 0 to 1. Null texts, texts
    without letters, and all texts if nothing could be learned, are ``und`` with
    score 0. Null ids are not held out; repeated rows are predicted each. Other
    columns are ignored. Every language takes a megabyte of each worker.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang", "text")
    found = prototypes(rows.filter("not held_out")).orderBy("lang").collect()  # one vector per language
    shared = docs.sparkSession.sparkContext.broadcast(([r.lang for r in found], [np.array(r.vector) for r in found]))
    return bounded_batches(rows).drop("lang").mapInArrow(
        _predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )
