import os
import random

import pytest

import corpus_pipeline
from palimpsest.llm import langid, minhash, packing, quality
from tests.llm.test_minhash import brute

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def key(r):
    return (r["doc_id"], r["piece"])


def test_run_against_a_plain_version(spark):
    """The stages on rows in the driver: the models' own predictions, all pairs compared, the tokens counted."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    kept = []
    for r in rows:
        if r["text"] and langid._LETTER.search(r["text"]):
            if model.predict(r["text"])[1] >= corpus_pipeline.LEAST_SURE:
                kept.append(r)
    first = spark.createDataFrame(kept, docs.schema)
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, SMALL).collect())
    model = quality.train(quality.labelled(first, spark.read.parquet(f"{SMALL}/labels.parquet")))
    of = quality.Features()
    kept = [r for r in kept if model.score(of(r["text"])) >= corpus_pipeline.LEAST_QUALITY]
    alone = {doc for doc, _, _, ok in brute([(r["doc_id"], r["text"]) for r in kept], k=5) if ok}
    kept = [r for r in kept if r["doc_id"] in alone]
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in kept} and len(out) > 0
    pieces = packing.tokenised(spark.createDataFrame(kept, docs.schema), packing.path("byte_bpe_50k.tiktoken"), 2, 1024).collect()
    assert sorted(map(key, pieces)) == sorted(map(key, out))


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_stages_take_empty_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(20).union(spark.createDataFrame([(None, None, None, None, None), (None, "a text", "en", "web", 6), (7, "", None, None, 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        stage(spark, odd, SMALL).collect()


def test_near_duplicates_use_five_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SMALL).collect()) == [1, 3]
    assert minhash.near_duplicates(docs).where("doc_id = 1").first()["n_shingles"] == 3


def test_clean_documents_of_a_large_family_are_kept(spark):
    rng = random.Random(3)
    langs = ["da", "de", "en", "nb", "nl", "sv"]
    words = {x: ["".join(rng.choices("abcdefghijklmnoprstuvy", k=rng.randrange(3, 9))) for _ in range(40)] for x in langs}
    rows = [(i, " ".join(rng.choices(words[x], k=40)), x, "web", 0) for i, x in enumerate(langs * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, SMALL).count() == len(rows)
    model = langid.train(docs)
    assert all(model.predict(text)[0] == x and model.predict(text)[1] >= 0.8 for _, text, x, *_ in rows)
    mixed = " ".join(w for own in zip(*words.values()) for w in own)
    assert model.predict(mixed)[1] < corpus_pipeline.LEAST_SURE


def test_equal_rows_stay_once_and_any_column_passes(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, "h i j k l m n", "x"), (4, "one text of this id", "x"), (4, "and another one of it", "x"), (None, "no id", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame([(*r, "en", 1.0) for r in rows], "doc_id long, text string, _stage_sure string, lang string, _stage_quality double")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.distinct(spark, docs, SMALL).collect())
    assert got == sorted([("1", rows[0][1]), ("3", rows[3][1]), ("4", rows[4][1]), ("4", rows[5][1]), ("None", "no id"), ("None", "no id")])
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and all(r["_stage_sure"] == "x" and r["_stage_quality"] == 1.0 for r in out.collect())
