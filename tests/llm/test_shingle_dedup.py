import random

import numpy as np
from pyspark.sql import functions as F

from railwatch.llm import shingle_dedup
from tests.llm.brute import documents

SMALL = "/root/testdata/sf0.01"


def shingles(text):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def least_of_classes(rows):
    """The least id of every class that pairs of Jaccard 0.8 or more make, by comparing all pairs."""
    sets, owner = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                owner[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r.doc_id for r in shingle_dedup.one_of_each(documents(spark, rows, clashing=True)).collect())


def test_planted_copies(spark):
    r = random.Random(6)
    line = " ".join(f"l{i}" for i in range(60))
    rows = []
    for n in (12, 40, 90, 150, 400):
        base = [f"w{r.randrange(10_000)}" for _ in range(n)]
        rows.append(" ".join(base))
        for words in (1, 1, 2, 3, 5, 8):
            changed = list(base)
            for at in r.sample(range(n), min(words, n)):
                changed[at] = f"x{r.randrange(10_000)}"
            rows.append(" ".join(changed))
        rows += [" ".join(base[: n * p // 100]).upper() for p in (95, 90, 85, 82, 78, 70)]
    rows += [f"{line} {' '.join(f'w{r.randrange(10_000)}' for _ in range(n))}" for n in (3, 5, 8, 10, 12, 15, 20, 40) for _ in range(3)]
    rows += ["", None, " ", "one two", "One  TWO", "one three"]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    assert kept(spark, rows) == least_of_classes(rows)


def test_real_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert kept(spark, rows) == least_of_classes(rows)


def test_a_prefix_meets_every_similar_set():
    assert [shingle_dedup.prefix_size(n) for n in (1, 4, 5, 10, 11)] == [1, 1, 2, 3, 3]


def test_bitmaps_rule_out_no_similar_pair(spark):
    draw = random.Random(8)
    rows, want = [], []
    for n in (3, 20, 120, 900, 4000):
        for change in (0.0, 0.03, 0.1, 0.2, 1.0):
            a = np.array(sorted({draw.getrandbits(64) for _ in range(n)}), np.uint64)
            b = np.array(sorted({x if draw.random() >= change else draw.getrandbits(64) for x in a.tolist()}), np.uint64)
            rows.append((len(a), len(b), *(shingle_dedup.parity_bitmap(x).tolist() for x in (a, b))))
            want.append(shingle_dedup.similar(a, b))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, sa long, sb long, a array<long>, b array<long>")
    may = table.select("i", shingle_dedup.may_be_similar(*(F.col(c) for c in ("sa", "sb", "a", "b"))).alias("may"))
    got = [r.may for r in may.orderBy("i").collect()]
    assert all(g or not w for g, w in zip(got, want)) and sum(got) < len(got) and sum(want) > 5


def test_pairs_that_bitmaps_rule_out_are_not_made(spark, monkeypatch):
    draw, base = random.Random(3), " ".join(f"b{i}" for i in range(85))
    blocks = [" ".join(f"k{n}x{i}" for i in range(7)) for n in range(20)]
    rows = [(n, " ".join([base, *(f"o{n}x{i} p{n}x{i} {b}" for i, b in enumerate(draw.sample(blocks, 3)))])) for n in range(60)]
    made, real = [], shingle_dedup._verify
    monkeypatch.setattr(shingle_dedup, "_verify", lambda pairs, *more: made.append(pairs.count()) or real(pairs, *more))
    assert kept(spark, rows) == least_of_classes(rows)
    assert made[-1] < 30
