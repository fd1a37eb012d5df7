"""A corpus pipeline of four stages over ``documents``: language, quality, near duplicates, packing.

Each stage takes all that the one before kept; its result is written as Parquet and read again. The first three return the
columns of documents; the last returns pieces and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, minhash, packing, quality
from palimpsest.llm.common import broadcast_if_small, materialise, read

#: A document whose language is found with less certainty is rejected, like one without a letter.
LEAST_SURE = 0.4
#: A document that scores less is rejected.
LEAST_QUALITY = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a language that is found with some certainty."""
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    pred, sure = _free(docs, "_stage_language"), _free(docs, "_stage_sure")
    found = langid.identify(docs, model, pred=pred, sure=sure)
    return found.where((F.col(pred) != "und") & (F.col(sure) >= LEAST_SURE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality, as learnt from the labels of those that are here."""
    model = quality.train(quality.labelled(docs, read(spark, sf_dir, "labels")))
    name = _free(docs, "_stage_quality")
    return quality.score(docs, model, name=name).where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows with the same id and text one stays; an id with several texts keeps one row of each. Rows without id all stay.
    """
    groups = minhash.near_duplicates(docs, shingle_words=5, percent=80)
    gone = materialise(groups.where("NOT kept").select("doc_id").distinct())
    often = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    often = broadcast_if_small(often, 16)
    left = docs.join(broadcast_if_small(gone, 16), "doc_id", "left_anti").select(*docs.columns)
    once, more = left.join(often, "doc_id", "left_anti"), left.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("packing", packed)]

#: SQL can express none of the trained or hashed stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
