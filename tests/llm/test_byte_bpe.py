import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from railwatch.llm import byte_bpe, queries
from tests.llm.brute import documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, byte_bpe.ID).tolist()


def lowest_pair_first(piece, rank):
    """One merge at a time: the lowest rank, leftmost of equal ones, found by looking at all pairs."""
    parts = [piece[at : at + 1] for at in range(len(piece))]
    while len(parts) > 1:
        best = min((rank.get(a + b, 1 << 60), at) for at, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [rank[p] for p in parts]


@pytest.mark.parametrize("alphabet", ["ab", "a", "aé漢\n \t1'", "theandiingr", "🙂‍́x"])
def test_encodes_like_the_library(ranks, library, alphabet):
    draw = random.Random(alphabet)
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for size in [0, 1, 2, 3, 5, 17, 80, 400, 1500] * 6:
        text = "".join(draw.choice(alphabet) for _ in range(size))
        packed = encoder.encode(text)
        assert ids_of(packed) == library.encode_ordinary(text)
        assert byte_bpe.decoded(packed, ranks) == text.encode()


def test_very_long_pre_token(ranks, library):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(200_000))
    assert ids_of(byte_bpe.merge_all([text.encode()], ranks)[0]) == library.encode_ordinary(text)


def test_lower_ranks_that_a_merge_brings_go_first():
    # Joining a and b (rank 260) makes abc possible (rank 257), which goes before the other a b on the right.
    extra = [(b"bc", 256), (b"abc", 257), (b"ca", 258), (b"cab", 259), (b"ab", 260), (b"aba", 261), (b"bb", 262), (b"abab", 263)]
    some = byte_bpe.Ranks([(bytes([b]), b) for b in range(256)] + extra)
    draw = random.Random(3)
    pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randrange(0, 25))) for _ in range(3000)]
    for piece, packed in zip(pieces, byte_bpe.merge_all(pieces, some)):
        assert ids_of(packed) == lowest_pair_first(piece, some.rank), piece


def test_queue_gives_lowest_rank_first():
    queue, draw = byte_bpe.RankQueue(50_000), random.Random(1)
    ranks = draw.sample(range(50_000), 3000)
    for rank in ranks:
        queue.push(rank, [2, 1])
    assert [queue.pop() for _ in ranks] == [(r, [1, 2]) for r in sorted(ranks)]
    assert queue.pop() is None


def test_cache_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(byte_bpe, "STEP", 40)
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = " ".join(f"w{n}x{n * 7919}" for n in range(400))
    packed = encoder.encode(text)
    assert byte_bpe.decoded(packed, ranks) == text.encode() and max(len(encoder.young), len(encoder.old)) <= 50
    assert packed == byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(text)


def test_texts_together_equal_texts_alone(ranks, monkeypatch):
    draw = random.Random(9)
    texts = ["".join(draw.choice("ab c\n") for _ in range(draw.randrange(0, 90))) for _ in range(300)]
    alone = [byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "STEP", 60)
    assert byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode_all(texts) == alone


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="255 of the 256"):
        byte_bpe.Ranks([(b"a", 0)])


def test_unknown_id_is_refused(ranks):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        byte_bpe.decoded(np.array([70_000], byte_bpe.ID).tobytes(), ranks)


def test_odd_rows(spark, ranks, library):
    rows = [(1, None), (2, ""), (None, "a <|endoftext|> b"), (3, "twice"), (3, "twice"), (4, " \n\n\t x  "), (5, "ab " * 300_000)]
    docs = documents(spark, rows, clashing=True).withColumn("ids", F.lit("an extra column"))
    found = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted((i or 0, t or "") for i, t in rows)
    got = sorted(found, key=lambda r: (r.doc_id or 0, r.decoded))
    assert [(r.doc_id or 0, bytes(r.decoded).decode()) for r in got] == want
    assert all(ids_of(r.ids) == library.encode_ordinary(t) and r.n_tokens == len(ids_of(r.ids)) for r, (_, t) in zip(got, want))


def test_empty_table(spark):
    encoded = byte_bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert byte_bpe.decode(encoded, PATH).collect() == []


def test_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), byte_bpe.ID)
        want[doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    found = queries.op11_byte_bpe(spark, FOLDER).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want
