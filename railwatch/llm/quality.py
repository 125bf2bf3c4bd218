"""A quality classifier by compression.

Two zstandard dictionaries are trained, one on texts labelled good and one on
texts labelled bad. A text is cut into short pieces, so that a dictionary is
what a piece is compressed with and not the text before it, and every piece is
compressed with both. The difference of the summed sizes, divided by their sum,
says which dictionary knows the text better. A logistic curve, fitted on
labelled texts that the dictionaries have not seen, turns it into a
probability. A few bytes say little, so the evidence counts by the length of
the text, and without any the score is the share of good labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.llm.common import bounded_batches, held_out, raw, schema_of
from railwatch.session import stored

PIECE_BYTES = 256
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3
SEED = 7
# Bounds of what is learned from: labelled texts per label, and bytes of each, cut into pieces drawn over its whole length.
TEXTS_PER_LABEL = 2000
SAMPLE_PIECES = 16
# A fourth of the texts drawn fits the curve instead of a dictionary.
CURVE_PART = 4
# Evidence of so many bytes counts half.
HALF_BYTES = 100

# Dictionaries of good and bad text; slope and offset of the curve; log odds of a good label.
Model = tuple[bytes, bytes, float, float, float]


def pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE_BYTES] for at in range(0, len(text), PIECE_BYTES)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class _Scorer:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = _compressor(good).compress, _compressor(bad).compress

    def difference(self, text: bytes) -> float:
        """From -1 (the bad dictionary knows the text) to 1; 0 for an empty text."""
        good = bad = 0
        for piece in pieces(text):
            good += len(self.good(piece))
            bad += len(self.bad(piece))
        return (bad - good) / (bad + good) if good else 0.0


def _clear(labels: DataFrame) -> DataFrame:
    """doc_id and quality outside the held-out fold, without documents that have labels of both kinds."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy("doc_id")
    both = known.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    return both.filter("quality = most").select("doc_id", "quality")


def _drawn(documents: DataFrame, clear: DataFrame) -> list:
    """Up to ``TEXTS_PER_LABEL`` labelled texts of each label in a seeded order, as pieces from all over the text.

    Of rows that share an id one is used.
    """
    clear = clear.withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))
    chosen = None
    for label in (0, 1):
        part = clear.filter(F.col("quality") == label).orderBy("order", "doc_id").limit(TEXTS_PER_LABEL).select("doc_id", "quality", "order")
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.encode(F.col("text"), "utf-8")
    # Pieces stand at even distances.
    count = F.least(F.lit(SAMPLE_PIECES), F.ceil(F.octet_length("text") / PIECE_BYTES)).cast("int")
    step = F.octet_length("text") / count
    places = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(i * step).cast("int") + 1)
    sample = F.transform(places, lambda at: F.substring(text, at, F.lit(PIECE_BYTES)))
    found = documents.join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") > 0)
    rows = found.groupBy("doc_id", "quality", "order").agg(F.min(sample).alias("sample"))
    return sorted(rows.collect(), key=lambda r: (r.order, r.doc_id))


def _evidence(length: np.ndarray) -> np.ndarray:
    return length / (length + HALF_BYTES)


def _logistic(x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the evidence beside the log odds of ``y``, by Newton's method with a small ridge."""
    scale, share = x.std() or 1.0, y.mean()
    points = np.column_stack([x / scale, np.ones(len(x))]) * _evidence(length)[:, None]
    weights, before = np.zeros(2), np.log(share / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(points @ weights + before, -30, 30)))
        gradient = points.T @ (y - p) - 1e-2 * weights
        hessian = (points * (p * (1 - p))[:, None]).T @ points + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most a fourth of the samples' size; empty where they are too few to train one."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Both dictionaries and the curve; None where one label has too little text to learn from."""
    clear = stored(_clear(labels), "clear")
    share = clear.agg(F.avg("quality")).first()[0]
    if share in (None, 0.0, 1.0):
        return None
    rows = _drawn(documents, clear)
    parts: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
    for row in rows:
        learn, check = parts[row.quality]
        (check if len(learn) >= (CURVE_PART - 1) * (len(check) + 1) else learn).append(bytes_of(row.sample))
    good, bad = (_dictionary([p for sample in parts[label][0] for p in sample]) for label in (1, 0))
    if not good or not bad:
        return None
    scorer = _Scorer(good, bad)
    x, length, y = [], [], []
    for label, (_, check) in parts.items():
        texts = [b"".join(sample) for sample in check]
        x += map(scorer.difference, texts)
        length += map(len, texts)
        y += [label] * len(texts)
    if len(set(y)) < 2:
        return None
    curve = _logistic(np.array(x), np.array(length, float), np.array(y, float))
    return good, bad, *curve, float(np.log(share / (1 - share)))


def bytes_of(sample) -> list[bytes]:
    return [bytes(p) for p in sample]


def _scored(shared, score: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Append the score of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(*model[:2]) if model else None
        slope, offset, before = model[2:] if model else (0.0, 0.0, 0.0)
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column("text"))]
            found = np.array([scorer.difference(t) if scorer else 0.0 for t in texts], float)
            odds = before + _evidence(np.array([len(t) for t in texts], float)) * (slope * found + offset)
            scores = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score])

    return run


def _with_score(rows: DataFrame, documents: DataFrame, labels: DataFrame, model: Model | None, score: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model or fit(documents, labels))
    return bounded_batches(rows).mapInArrow(_scored(shared, score), f"{schema_of(rows, *rows.columns)}, {score} double")


def score(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1: good).

    The score is the probability of label 1. It is read off the whole text alone.
    Null and empty texts give no evidence. Where the labels teach nothing
    (none, or of one kind) every score is 0.5. Null ids are not held out;
    repeated rows are scored each; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = _with_score(rows, rows, labels, model, "score").drop("text")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    scored = _with_score(documents, documents, labels, model, "_quality")
    return scored.filter(F.col("_quality") >= THRESHOLD).select(*documents.columns)
