import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from railwatch.llm import packing, queries, token_counts
from tests.llm.brute import documents, ids_of

SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
# Texts that are hard to cut: edges, runs of white space, marks, other scripts, special strings.
PARTS = ["a", "the", "Ing", " ", "  ", "\n", "\t", "\r\n", "\x00", "▁", "é", "É", "é", "İ", "日本", "😀", "\xa0", "　", "123", "'s", "."]
PARTS += ["<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "%%%", "\x1c", "\u0085", "Σ", "…"]


def odd_texts(n):
    r = random.Random(1)
    return ["".join(r.choices(PARTS, k=r.randint(0, 9))) for _ in range(n)]


def placed(df):
    rows = df.collect()
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= packing.CAPACITY
    return rows, len(by_sequence)


def expected_pieces(rows):
    tokenizer, out = Tokenizer.from_file(WORDS), []
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        for number, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            out.append((doc_id, number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def pieces_of(rows):
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)


def test_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(odd_texts(3000))) + [(-1, None), (None, "the the"), (7, "the"), (7, "the"), (-2, "the day\n" * 30_000)]
    got = token_counts.count_tokens(documents(spark, rows, clashing=True), PIECES).collect()
    expected = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_counts_with_a_full_cache(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "TEXT_CACHE", 3)
    monkeypatch.setattr(token_counts, "_cache", {})
    model, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), [" ".join(f"w{i}{j}" for j in range(9)) for i in range(5)]

    class Shared:
        value = {"w00": 3}

    Shared.value = dict(zip(["w00"], token_counts._encoded_lengths(model, ["w00"])))
    batch = documents(spark, list(enumerate(texts))).selectExpr("doc_id", "text", "0L n_bytes").toArrow().to_batches()
    got = [n for b in token_counts._counted(PIECES, Shared)(iter(batch)) for n in b.column("n_tokens").to_pylist()]
    assert got == [len(model.encode(t)) for t in texts]


def test_counts_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = queries.op6_token_counts(spark, SMALL).collect()
    expected = {r.doc_id: len(model.encode(r.text)) for r in rows}
    assert {r.doc_id: r.n_tokens for r in got} == expected
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_no_documents(spark):
    assert token_counts.count_tokens(documents(spark, []), PIECES).count() == 0
    assert packing.pack(documents(spark, []), WORDS).count() == 0


def test_pieces_equal_the_library(spark):
    rows = list(enumerate(odd_texts(3000))) + [(-1, None), (None, "a b"), (7, "a b"), (7, "a b"), (-2, "word and, Word. " * 9000)]
    got, _ = placed(packing.pack(documents(spark, rows, clashing=True), WORDS))
    assert pieces_of(got) == expected_pieces(rows)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = np.zeros(65, np.int64)
        for length in rng.integers(1, 65, rng.integers(1, 200)):
            counts[length] += rng.integers(1, 4)
        plan, used = packing.best_two_fit(counts), np.zeros(65, np.int64)
        for pattern, times in plan:
            assert sum(pattern) <= 64
            for length in pattern:
                used[length] += times
        assert (used == counts).all()
        whole = -(-int(counts @ np.arange(65)) // 64)
        assert sum(t for _, t in plan) <= 1.25 * whole + 1


def test_smallest_piece_gives_way_to_a_tighter_pair():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6 + 3 leaves 1; 6 + 2 + 2 leaves none
    assert packing.best_two_fit(counts)[0] == ([6, 2, 2], 1)


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got, sequences = placed(queries.op3_best_fit_packing(spark, SMALL))
    assert pieces_of(got) == expected_pieces(rows)
    assert sequences <= 1.02 * sum(r.length for r in got) / packing.CAPACITY + 1
