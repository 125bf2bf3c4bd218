import random

import numpy as np

from railwatch.functions import components as links_of
from railwatch.functions.components import roots
from railwatch.llm import golay, queries, simhash
from tests.llm.brute import components, documents, fingerprint

SMALL = "/root/testdata/sf0.001"


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = components(prints)
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 23, 300)
    keys, there = golay.indices(values)
    assert set(there.sum(axis=1)) <= {1, 6}
    for value, own, mask in zip(values, keys, there):
        flipped = value ^ int(sum(1 << int(b) for b in rng.choice(23, 2, replace=False)))
        other, other_mask = golay.indices(np.array([flipped]))
        assert set(own[mask]) & set(other[0][other_mask[0]])


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 64, 1, dtype=np.uint64)
        b = a.copy()
        for bit in rng.choice(64, 4, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        assert set(simhash.fuzzy_keys(a)[0]) & set(simhash.fuzzy_keys(b)[0])


def test_spanning_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    prints = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3))) for c in centre for _ in range(40)])
    links = simhash.spanning_links(prints.view(np.int64))
    assert len(links) < len(prints)
    number = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    owner = list(range(len(prints)))

    def find(i):
        return i if owner[i] == i else find(owner[i])

    for a, b in links:
        owner[find(number[a])] = find(number[b])
    brute = components(prints)
    pairs = {(find(i), brute[i]) for i in range(len(prints))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_keys_with_many_fingerprints_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    prints = np.unique([sum(1 << int(b) for b in rng.choice(64, 2)) for _ in range(150)]).astype(np.int64)
    table = spark.createDataFrame([(int(p),) for p in prints], "print long")
    got = {r.node: r.root for r in roots(simhash.near_links(table)).collect()}
    group = components(prints.view(np.uint64))
    mine = [got.get(int(p), int(p)) for p in prints]
    assert len(set(zip(mine, group))) == len(set(mine)) == len(set(group))


def test_chain_has_one_root(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 101)], "node long, to long")
    got = {r.node: r.root for r in roots(links).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}


def test_stars_are_left_after_one_round(spark, monkeypatch):
    written, real = [], links_of.stored
    monkeypatch.setattr(links_of, "stored", lambda df, name: written.append(name) or real(df, name))
    links = spark.createDataFrame([(0, i) for i in range(1, 20)], "node long, to long")
    assert {r.node: r.root for r in roots(links).collect()} == {i: 0 for i in range(1, 20)}
    assert len(written) == 2


def test_equals_brute_force(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(7, " ".join(base)), (3, " ".join(base).upper()), (8, " ".join(base[:-1])), (9, " ".join([*base, "more"]))]
    for i in range(40):
        changed = list(base)
        changed[r.randrange(120)] = f"x{i}"
        rows.append((20 + i, " ".join(changed)))
    rows += [(60, None), (61, ""), (62, " \n"), (63, "one"), (64, "one two three"), (65, "ÉCOLE école"), (3, " ".join(base)), (None, "one")]
    got = simhash.near_duplicates(documents(spark, rows, clashing=True)).collect()
    mine = sorted(((x.doc_id, f"{x.print & (2**64 - 1):016x}", x.component_id) for x in got), key=repr)
    assert mine == expected(rows)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "quite another text here now"), (None, None)]
    got = simhash.one_of_each(documents(spark, rows)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got if x.text) == [(2, "a b c d e"), (9, "quite another text here now")]
    assert len(got) == 3


def test_different_texts_without_ids_all_stay(spark):
    r = random.Random(5)
    rows = [(None, " ".join(f"w{r.randrange(10_000)}" for _ in range(30))) for _ in range(1_500)]
    assert len({t for _, t in rows}) == simhash.one_of_each(documents(spark, rows)).count() == 1_500


def test_no_documents(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(60_001))
    got = simhash.near_duplicates(documents(spark, [(1, text)])).first()
    assert got["print"] & (2**64 - 1) == fingerprint(text)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op4_simhash_near_dedup(spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
