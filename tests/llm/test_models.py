import random

import numpy as np
import pyarrow as pa
import pytest

from railwatch.llm import language_id, quality, queries
from tests.llm.brute import documents, is_held_out

FOLDER = "/root/testdata/sf0.01"


def sentence(seed, letters, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def two_kinds():
    good = [(i, sentence(i, "aeiorst")) for i in range(0, 400, 2)]
    bad = [(i, sentence(i, "qxzjk%$#")) for i in range(1, 400, 2)]
    return good, bad


def test_compression_tells_kinds_apart(spark, two_kinds):
    good, bad = two_kinds
    odd = [(1000, None), (1001, ""), (None, sentence(1, "aeiorst")), (1002, sentence(2, "aeiorst", 20_000))]
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    marks += [(0, 1, 1), (2, 0, 0), (None, 1, 0), (4, None, None), (9999, 1, 0)]
    table = quality.score(documents(spark, good + bad + odd, clashing=True), labels(spark, marks))
    rows = {r.doc_id: r for r in table.collect()}
    assert len(rows) == 404
    assert all(r.held_out == is_held_out(i) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in rows.values())
    assert np.mean([rows[i].predicted == 1 for i, _ in good]) > 0.97
    assert np.mean([rows[i].predicted == 0 for i, _ in bad]) > 0.9
    assert rows[1000].score == rows[1001].score
    assert rows[1002].predicted == rows[None].predicted == 1


def test_held_out_labels_teach_nothing(spark, two_kinds):
    good, bad = two_kinds
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    turned = [(i, 1 - q if is_held_out(i) else q, t) for i, q, t in marks]
    docs = documents(spark, good + bad)
    assert sorted(quality.score(docs, labels(spark, marks)).collect()) == sorted(quality.score(docs, labels(spark, turned)).collect())


def test_nothing_to_learn_from(spark, two_kinds):
    good, _ = two_kinds
    for marks in ([], [(i, 1, 0) for i, _ in good]):
        assert {r.score for r in quality.score(documents(spark, good), labels(spark, marks)).collect()} == {0.5}
    assert quality.score(documents(spark, []), labels(spark, [])).count() == 0
    assert language_id.identify(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents(spark, [(1, "abc", None, "s")])).collect()} == {"und"}


def test_accepted_rows_keep_their_columns(spark, two_kinds):
    good, bad = two_kinds
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    docs = documents(spark, good + bad, clashing=True)
    kept = quality.accepted(docs, labels(spark, marks))
    assert kept.columns == docs.columns
    chosen = {r.doc_id for r in quality.score(docs, labels(spark, marks)).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == chosen


def test_quality_query_on_held_out_rows(spark):
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality_classifier(spark, FOLDER).collect() if r.held_out and r.doc_id in known]
    good = [r.score for r in rows if known[r.doc_id] == 1]
    bad = [r.score for r in rows if known[r.doc_id] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([g >= quality.THRESHOLD for g in good]) > 0.97


def test_trigrams_of_a_text_cut_in_parts(monkeypatch):
    text = "Ab, c dé  (fgh) " * 30 + "z"
    whole = np.concatenate(list(language_id.trigrams(text)))
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(language_id, "_AT_ONCE", size)
        assert np.concatenate(list(language_id.trigrams(text))).tolist() == whole.tolist()


def test_products_with_a_prototype_equal_vector_products():
    vectors = language_id._letter_vectors()
    prototype = np.random.default_rng(1).normal(size=language_id.DIMENSIONS)
    table = language_id._products(prototype)
    for a, b, c in ((0, 1, 2), (5, 5, 5), (63, 0, 27)):
        bound = np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
        number = (a * language_id.CLASSES + b) * language_id.CLASSES + c
        counts = np.zeros(language_id.CLASSES**3)
        counts[number] = 3
        assert np.allclose(language_id._bundled(counts), 3 * bound)
        assert np.isclose(table[number], bound @ prototype, atol=1e-2)


def test_languages(spark):
    rows = [(i, sentence(i, "aeiou"), "xx", "s") for i in range(100)] + [(100 + i, sentence(i, "лнтсаи"), "yy", "s") for i in range(100)]
    odd = [(300, None, "xx", "s"), (301, "", "xx", "s"), (302, "12 + 3", "yy", "s"), (303, "A", None, None), (None, "лнт", None, "s")]
    odd += [(304, sentence(3, "aeiou", 200_000), None, "s"), (305, "ао", "zz", "s")]
    got = {r.doc_id: r for r in language_id.identify(documents(spark, rows + odd, clashing=True)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [got[i].lang_pred for i in (300, 301, 302, None, 304)] == ["und", "und", "und", "yy", "xx"]
    assert got[303].lang_pred != "und"
    assert all(0 <= r.score <= 1 and r.held_out == is_held_out(i) for i, r in got.items())


def test_language_query_on_held_out_rows(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r for r in queries.op10_language_id(spark, FOLDER).collect() if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows]) > 0.97


def test_score_of_a_text_does_not_depend_on_its_parts(monkeypatch):
    text = " ".join(["the quick brown fox jumps over the lazy dog"] * 50)
    whole = [c.tolist() for c in language_id._counted(language_id.trigrams(text))]
    monkeypatch.setattr(language_id, "_AT_ONCE", 100)
    assert [c.tolist() for c in language_id._counted(language_id.trigrams(text))] == whole
    vector = np.random.default_rng(0).normal(size=language_id.DIMENSIONS)
    shared = type("Shared", (), {"value": (["en"], [language_id._bundled(np.bincount(whole[0], whole[1], language_id._TRIGRAMS)) + vector])})
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [False], "text": [text]})
    parts = next(language_id._predicted(shared)(iter([batch]))).column("score")[0].as_py()
    monkeypatch.undo()
    assert parts == next(language_id._predicted(shared)(iter([batch]))).column("score")[0].as_py()
