import random

import pytest

from railwatch.llm import mixing, queries
from tests.llm.brute import documents, water_filling, words

SMALL = "/root/testdata/sf0.001"


def expected_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    return dict(zip(names, water_filling([sizes[n] for n in names], mixing.WEIGHTS, mixing.SHARE_OF_ALL, mixing.MAX_EPOCHS)))


def check(rows, got):
    """``rows``: (doc_id, text, lang, source); ``got``: rows of the mix."""
    source, size = {r[0]: r[3] for r in rows}, {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    targets, taken = expected_targets(size), {}
    assert len(got) == len(rows)
    for r in got:
        name = source[r.doc_id]
        assert r.source_size == size[name]
        assert r.target == pytest.approx(targets[name], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[name] = taken.get(name, 0) + r.taken
    for name, total in taken.items():
        assert abs(total - targets[name]) <= 1


def sample():
    r = random.Random(1)
    sources = ["b", "a", "é", "Z", "a1", "", None, "tiny", "empty"]
    weights = [40, 300, 30, 20, 10, 5, 25, 1, 3]
    rows = []
    for name, n in zip(sources, weights):
        for _ in range(n):
            text = None if name == "empty" else " ".join(["w"] * r.randrange(1, 60))
            rows.append((len(rows), text, "en", name))
    return [*rows, (10_000, "", "en", "a"), (10_001, "a\u00a0b\tc\n\x0bd", None, "a"), (10_002, "w " * 30_000, "en", "b")]


def test_equals_water_filling(spark):
    rows = sample()
    got = mixing.mix(documents(spark, rows, clashing=True)).collect()
    check(rows, got)
    assert {r.doc_id: r.size for r in got} == {r[0]: len(words(r[1])) for r in rows}
    again = mixing.mix(documents(spark, random.Random(2).sample(rows, len(rows)))).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_one_source_and_none(spark):
    rows = [(i, "w w w", "en", "a") for i in range(10)]
    assert sum(r.taken for r in mixing.mix(documents(spark, rows)).collect()) == 45
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None, "en", "a")])).collect()] == [0]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "w w", "en", "a")] * 5 + [(None, "w w", "en", "a")] * 5
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == 10 and sum(r.taken for r in got) == 30
    copies = mixing.repeated(documents(spark, rows)).collect()
    assert len(copies) == 15


def test_repeated_rows_follow_the_mix(spark):
    rows = sample()
    docs = documents(spark, rows)
    wanted = {r.doc_id: r.taken / (r.size or 1) for r in mixing.mix(docs).collect()}
    made = {}
    for r in mixing.repeated(docs).collect():
        made[r.doc_id] = made.get(r.doc_id, 0) + 1
    assert made == {i: int(n + 0.5) for i, n in wanted.items() if n >= 0.5}


def test_query(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, queries.op8_source_mixing(spark, SMALL).collect())


def test_copies_stay_with_their_source(spark):
    """One id and text in two sources, and in rows that differ in another column only."""
    text = "a b c"
    rows = [(1, text, "en", "s1"), (1, text, "en", "s2"), (1, text, None, "s2"), (2, "d " * 300, "en", "s2"), (3, "e " * 9, "en", "s1")]
    docs = documents(spark, rows)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken.setdefault((r.doc_id, r.source_size), []).append(round(r.taken / r.size))
    copies = {}
    for r in mixing.repeated(docs).collect():
        copies[r.doc_id, r.source, r.lang] = copies.get((r.doc_id, r.source, r.lang), 0) + 1
    assert [copies.get((1, "s1", "en"), 0)] == taken[1, 12]
    assert sorted(copies.get((1, "s2", lang), 0) for lang in ("en", None)) == sorted(taken[1, 306])
    words = sum(len(dict((r[0], r[1]) for r in rows)[i].split()) * n for (i, s, _), n in copies.items() if s == "s1")
    target = next(r.target for r in mixing.mix(docs).collect() if r.source_size == 12)
    assert abs(words - target) <= 9
