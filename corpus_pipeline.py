"""Corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on everything that the stage before it kept.
All but the last return the columns of ``documents``. Stages are written as Parquet in the shared folder and read again, so
that a lost executor costs one stage's tasks and no text is computed twice.

Nulls and odd rows: a text without letters, empty and null texts among them, has no language and is rejected by the first
stage; rows with a null ``doc_id`` pass the filters as any other, and are each a group of their own among near-duplicates;
further columns stay until packing. Empty tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import language, packing, pii, simhash, toxicity
from foliospark.llm.queries import vocabulary
from foliospark.session import fresh_path, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: all but those without a letter.

    Profiles are learned from the documents with a language outside fold 2 of 4. However small the best cosine is, a text
    of letters stays: clean texts of a word or two have cosines near 0. Where no document has a language, texts of letters
    stay as well.
    """
    profiles = language.fit(docs, folds=4, held=2)
    if not profiles.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, profiles, name="__lang", score="__cosine")
    return found.where(F.col("__lang") != "und").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels outside fold 0 of 5, gives a toxicity of less than one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return toxicity.score(docs, model, name="__score").where("__score < 0.5").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that SimHash links of at most 4 differing bits connect."""
    return simhash.first_of_each(docs, radius=4)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind, and with the new number of characters."""
    clean = pii.redacted(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("language", identified),
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Learned models and tokenizers are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
