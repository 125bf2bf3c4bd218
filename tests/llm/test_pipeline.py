import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from railwatch.llm import mixing, quality
from tests.llm.brute import documents, ids_of, without_repeats, words
from tests.llm.test_shingle_dedup import least_of_classes

FOLDER = "/root/testdata/sf0.01"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    order = ["quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == order

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    accepted = {r.doc_id for r in quality.score(docs, labels).filter("predicted = 1").collect()}
    good = stages["quality_classifier"](spark, docs, FOLDER)
    rows = {r.doc_id: r for r in good.collect()}
    assert rows.keys() == accepted and len(accepted) > 0.6 * docs.count()

    ids = sorted(rows)
    single = stages["simhash_near_dedup"](spark, documents(spark, [tuple(rows[i])[:4] for i in ids]), FOLDER)
    singles = {r.doc_id: r for r in single.collect()}
    assert sorted(singles) == least_of_classes([(i, rows[i].text) for i in ids])

    kept = documents(spark, [tuple(r)[:4] for r in singles.values()])
    clean = {r.doc_id: r for r in stages["substring_dedup"](spark, kept, FOLDER).collect()}
    brute = without_repeats([(r.doc_id, r.text) for r in singles.values()])
    assert sorted(clean) == sorted(i for i, (n, removed, _) in brute.items() if removed == 0 or removed < n)
    for i, r in clean.items():
        assert len(words(r.text)) == brute[i][0] - brute[i][1] and r.n_chars == len(r.text)
        assert brute[i][1] or r.text == singles[i].text

    mixed = stages["source_mixing"](spark, documents(spark, [tuple(r)[:4] for r in clean.values()]), FOLDER)
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    total = sum(len(words(clean[i].text)) * n for i, n in copies.items())
    whole = sum(len(words(r.text)) for r in clean.values())
    assert max(copies.values()) <= 2 and abs(total - mixing.SHARE_OF_ALL * whole) < 0.03 * whole

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(ids_of(tokenizer, clean[i].text)) for i in copies}
    packed = stages["best_fit_packing"](spark, documents(spark, [tuple(r)[:4] for r in mixed.collect()]), FOLDER).collect()
    assert sum(r.length for r in packed) == sum(lengths[i] * n for i, n in copies.items())


def test_run_equals_its_stages_and_agrees_with_itself(spark):
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001").drop("sequence_id", "offset").collect()
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001").drop("sequence_id", "offset").collect()
    assert sorted(first) == sorted(again) and first


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None), (None, "", "en", None), (2, "a b c", None, "s"), (2, "a b c", None, "s"), (None, None, None, None)]
    docs = documents(spark, rows, clashing=True)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, table, "/root/testdata/sf0.001")
            assert made.count() <= 2 * len(rows)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
