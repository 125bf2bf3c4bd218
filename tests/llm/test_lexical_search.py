import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from railwatch.llm import lexical_search, queries
from tests.llm.brute import documents

ITEMS = "item_id long, text string, score string, doc_id int, n string, terms int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


def terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(small)


def brute(rows, items, top=50):
    """item -> [(doc_id, score)], every document scored."""
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for doc_id, counts in held:
            m = 50 + 50 * counts.total() * n_docs // n_terms
            score = 0
            for term in wanted & set(counts):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += weight * (1_000_000_000 * counts[term] // (1000 * counts[term] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        scored = sorted(scored)[:top]
        if scored:
            out[item] = [(doc_id, -score) for score, _, _, doc_id in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id or 0, r.rank)):
        assert r.rank == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def corpus(n, draw):
    """Texts over words of very uneven frequency, some of them copies."""
    words = [f"w{int(draw.paretovariate(0.6)) % 500}" for _ in range(40 * n)]
    rows = [(i, " ".join(draw.sample(words, draw.randrange(1, 60)))) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(n // 4)]


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in items], ITEMS)


ODD = [
    (None, "alpha Beta"), (None, None), (9001, None), (9002, ""), (9003, "!? --"), (9004, "ALPHA alpha"), (9004, "alpha alpha"),
    (9005, "ÄÖ äö Ñandú İX"), (9006, "alpha\x00beta\x7fgamma_delta"), (9007, "beta " * 200_000),
]
ODD_ITEMS = [(1, "Alpha BETA beta, gamma"), (2, None), (3, ""), (None, "alpha"), (4, "ÄÖ ñandú İX"), (5, "unheard"), (1, "delta"), (6, "w0 w1 w2 w7 w9")]


@pytest.mark.parametrize("setting", [{}, {"SHARD_POSTINGS": 64, "BLOCK_TERMS": 2, "STEP": 16}, {"BROADCAST_BYTES": -1, "BLOCK": 4, "WINDOW": 16, "FIRST_WINDOW": 3}])
def test_equals_brute_force(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(lexical_search, name, value)
    rows = corpus(150, random.Random(4)) + ODD
    docs = documents(spark, rows, clashing=True).repartition(5)
    want = brute(rows, ODD_ITEMS, 7)
    assert found(lexical_search.rank_documents(docs, items_table(spark, ODD_ITEMS), 7)) == want
    assert set(want) == {1, None, 4, 6}


def lists_of(size, count, draw):
    out = []
    for _ in range(count):
        docs = np.array(sorted(draw.sample(range(size), draw.randrange(1, size))))
        impacts = np.array([int(draw.paretovariate(1.0) * 100) for _ in docs], np.uint32)
        out.append((draw.randrange(0, 900), docs, impacts))
    return out


def test_search_in_one_shard_equals_scoring_all(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 8)
    draw = random.Random(7)
    for width in (1, 10, 64):
        monkeypatch.setattr(lexical_search, "WINDOW", width)
        monkeypatch.setattr(lexical_search, "FIRST_WINDOW", width)
        for size in (2, 30, 300):
            lists = lists_of(size, 6, draw)
            sums = np.zeros(size, np.int64)
            for weight, docs, impacts in lists:
                sums[docs] += weight * impacts.astype(np.int64)
            order = [d for d in np.lexsort((np.arange(size), -sums)) if sums[d] > 0][:5]
            docs, scores = lexical_search.search([(w, lexical_search.Postings(d, i)) for w, d, i in lists], size, 5)
            assert docs.tolist() == order and scores.tolist() == sums[order].tolist()


def test_block_maxima_reject_before_blocks_are_decompressed(monkeypatch):
    """One rare heavy term and one frequent light one: the light list is hardly opened."""
    opened = []
    whole = lexical_search.Postings.impacts_of
    monkeypatch.setattr(lexical_search.Postings, "impacts_of", lambda self, docs, block: opened.append(len(set(block))) or whole(self, docs, block))
    size = 100_000
    rng = np.random.default_rng(2)
    rare = np.sort(rng.choice(size, 3000, replace=False))
    light = rng.integers(1, 100, size).astype(np.uint32)
    heavy = rng.integers(1_000, 900_000, len(rare)).astype(np.uint32)
    lists = [(9000, lexical_search.Postings(rare, heavy)), (10, lexical_search.Postings(np.arange(size), light))]
    docs, scores = lexical_search.search(lists, size, 50)
    sums = light.astype(np.int64) * 10
    sums[rare] += 9000 * heavy.astype(np.int64)
    assert docs.tolist() == np.lexsort((np.arange(size), -sums))[:50].tolist()
    assert sum(opened) < len(rare) / 10 < size / lexical_search.BLOCK


def test_postings_give_back_what_they_hold():
    docs = np.cumsum(np.random.default_rng(1).integers(1, 90_000, 1000))
    postings = lexical_search.Postings(docs, np.arange(1, 1001, dtype=np.uint32))
    for low, high in ((0, docs[-1] + 1), (docs[5], docs[700]), (docs[5] + 1, docs[5] + 1), (docs[-1], docs[-1] + 9)):
        held, impacts = postings.within(low, high)
        mask = (docs >= low) & (docs < high)
        assert held.tolist() == docs[mask].tolist() and impacts.tolist() == (np.flatnonzero(mask) + 1).tolist()


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "a")]), items_table(spark, [(1, "a")])
    assert lexical_search.rank_documents(documents(spark, []), items).collect() == []
    assert lexical_search.rank_documents(docs, items_table(spark, [])).collect() == []
    assert lexical_search.rank_documents(docs, items_table(spark, [(1, "b")])).collect() == []
    assert lexical_search.rank_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(queries.op12_lexical_search(spark, FOLDER)) == brute(rows, items)
