"""Token counts from a two-tier lookup of pre-token lengths.

No merge of this vocabulary crosses from a letter to a space, so a text falls
into pre-tokens whose lengths add up: a run of spaces with what follows it up to
the next space. A line feed is a token of its own and ends a pre-token too.

Most pre-tokens of a corpus are a few frequent ones. Each task of a first pass
sums up the pre-tokens of its rows and passes on the most frequent; the most
frequent of those, a fixed number, are encoded once and broadcast as a compact
hash table of lengths. The second pass looks pre-tokens up there, then in the
worker's own cache, and encodes the rest in batches. Pre-tokens are never
shuffled, only the summaries of tasks are. The table decides what is fast,
never what is counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railwatch.llm.common import bounded_batches, raw

FREQUENT = 32_768
SUMMARY = 8_192
TEXT_CACHE = 200_000
MAX_TOKENS = 4096

_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
_cache: dict[str, int] = {}

# Texts where a space is not followed by a letter or stands at an edge: rare, cut with care.
_IRREGULAR = re.compile(r"  | \n|^ | $|▁|\x00")


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text. One that follows a space starts with it unless it starts with a line feed.

    A regular text is cut by one ``split``: "a b\\nc" gives "a", "b", "\\nc", where
    a leading line feed says that no space stands before.
    """
    return text.replace("\n", " \n").split(" ")


def _encoded_lengths(model: sentencepiece.SentencePieceProcessor, keys: list[str]) -> list[int]:
    """Lengths of pre-tokens. The model puts a space before a text, as is wanted except after a line feed.

    After a line feed the rest has no space, so the whole is encoded and the two
    tokens of the added space and the line feed are taken off.
    """
    return [len(ids) - (k[0] == "\n") for k, ids in zip(keys, model.encode(keys, num_threads=1))]


def _whole_lengths(model: sentencepiece.SentencePieceProcessor, text: str) -> int:
    """Length of an irregular text, line by line so that memory follows the longest line."""
    total = 0
    for at, line in enumerate(re.split("(\n)", text)):
        if line == "\n":
            total += 1 + (at == 1 and text[0] == "\n")
        elif line:
            total += len(model.encode("\n" + line)) - 2 if at else len(model.encode(line))
    return total


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task; rare ones are let go whenever too many have gathered."""
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(pre_tokens(text or ""))
            if len(seen) > 8 * SUMMARY:
                seen = Counter(dict(seen.most_common(2 * SUMMARY)))
    seen.pop("", None)
    top = seen.most_common(SUMMARY)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pre_token", "n"]
    )


def frequent_lengths(docs: DataFrame, model_path: str) -> dict[str, int]:
    """Lengths of the ``FREQUENT`` pre-tokens that lead the summaries of all tasks."""
    summaries = bounded_batches(docs).select("text").mapInArrow(_summaries, "pre_token string, n long")
    short = summaries.filter(F.octet_length("pre_token") <= 64)
    top = short.groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(FREQUENT)
    keys = [r.pre_token for r in top.select("pre_token").collect()]
    return dict(zip(keys, _encoded_lengths(_model(model_path), keys)))


def _counted(model_path: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, model = shared.value, _model(model_path)
        first = frequent.get
        for batch in batches:
            sizes, lengths = [], []
            for size, text in zip(batch.column("n_bytes").to_pylist(), batch.column("text").to_pylist()):
                sizes.append(size)
                if not text:
                    lengths.append(0)
                    continue
                if text[0] == "\n" or _IRREGULAR.search(text):
                    lengths.append(_whole_lengths(model, text))
                    continue
                keys = pre_tokens(text)
                found = list(map(first, keys))
                missing = [k for k, n in zip(keys, found) if n is None]
                total = sum(filter(None, found))
                if missing:
                    new = list({k for k in missing if k not in _cache})
                    if len(_cache) + len(new) > TEXT_CACHE:
                        _cache.clear()
                        new = list(set(missing))
                    _cache.update(zip(new, _encoded_lengths(model, new)))
                    total += sum(map(_cache.__getitem__, missing))
                lengths.append(total)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, as the library encodes the whole text.

    Null texts count as empty: no bytes, no tokens. Repeated rows are counted
    each; null ids are passed on. Other columns are ignored.
    """
    rows = bounded_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path))
    return rows.mapInArrow(_counted(model_path, shared), "doc_id long, n_bytes long, n_tokens long")
