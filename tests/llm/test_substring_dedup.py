import hashlib
import random

import numpy as np
import pytest
import xxhash

from railwatch.llm import queries, substring_dedup
from tests.llm.brute import documents, without_repeats

SMALL = "/root/testdata/sf0.001"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10_000)}" for _ in range(n))


def result(df):
    rows = df.select("doc_id", "n_words", "n_removed", "kept").collect()
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}


def test_names_of_runs_tell_runs_apart():
    values = np.random.default_rng(1).integers(0, 1 << 60, 60).astype(np.uint64)
    for length in (1, 2, 3, 8, 13, 20):
        names = substring_dedup.run_names(np.concatenate([values, values]), length)
        count = 60 - length + 1
        assert len(names) == 121 - length
        assert (names[:count] == names[60 : 60 + count]).all()
        assert len(np.unique(names[:60])) == 60


def test_smallest_of_neighbours():
    values = np.random.default_rng(2).integers(0, 99, 50)
    for width in (1, 2, 5, 13):
        expected = [values[i : i + width].min() for i in range(51 - width)]
        assert substring_dedup._smallest(values, width).tolist() == expected


def test_equals_brute_force(spark):
    shared, other = passage(1, 60), passage(2, 25)
    rows = [
        (5, f"{passage(3, 30)} {shared} {passage(4, 10)}"),
        (2, f"{shared} {passage(5, 40)} {other}"),
        (9, f"{passage(6, 7)} {other} {other}\t{other}\n{passage(7, 3)}"),
        (11, shared),
        (12, " ".join(shared.split()[:19])),
        (13, " ".join(["same"] * 100)),
        (14, " ".join(["same"] * 21)),
        (15, "  \n\x0b "),
        (16, ""),
        (17, None),
        (18, f" {shared.replace(' ', chr(0xA0))}"),
        (None, shared),
    ]
    assert result(substring_dedup.remove_repeats(documents(spark, rows, clashing=True))) == without_repeats(rows)


def test_any_number_of_groups(spark):
    copies = passage(8, 80)
    rows = [(i, f"{passage(100 + i, 5)} {copies}") for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for groups in ("1", "3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", groups)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert result(substring_dedup.remove_repeats(documents(spark, rows).repartition(5))) == without_repeats(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_that_share_an_id(spark):
    text, other = passage(9, 30), passage(10, 30)
    rows = [(1, text), (1, text), (1, other), (2, f"{text} {other}")]
    got = substring_dedup.remove_repeats(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 60, 60)]


def test_texts_under_one_id_whose_hashes_end_alike(spark):
    shared, seen = passage(13, 30), {}
    for i in range(5_000):
        text = f"{shared} {passage(1_000 + i, 3)}"
        first = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFF, text)
        if first != text:
            break
    assert first != text
    for doc_id in (None, 1):
        got = substring_dedup.remove_repeats(documents(spark, [(doc_id, first), (doc_id, text)])).collect()
        assert sorted((r.n_words, r.n_removed) for r in got) == [(33, 0), (33, 30)]


def test_long_text(spark):
    text = passage(11, 120_000)
    got = result(substring_dedup.remove_repeats(documents(spark, [(1, text), (2, text)])))
    assert (got[1][:2], got[2][:2]) == ((120_000, 0), (120_000, 120_000))


def test_no_documents(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_cleaned_keeps_the_rest(spark):
    shared = passage(12, 40)
    rows = [(1, f"a\n{shared}", "de", "s1"), (2, f"b {shared} c", None, None), (3, shared), (4, None), (5, "")]
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in substring_dedup.cleaned(documents(spark, rows)).collect()}
    assert got == {
        1: (f"a\n{shared}", "de", "s1", len(shared) + 2),
        2: ("b c", None, None, 3),
        4: (None, "en", "src", None),
        5: ("", "en", "src", 0),
    }


@pytest.mark.parametrize("folder", [SMALL])
def test_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op1_substring_dedup(spark, folder).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == without_repeats(rows)
