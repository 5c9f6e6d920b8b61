"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; a stage's rows are written and read again before the
next. All but the last return the columns of ``documents``; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import decontaminate, jaccard, language, packing, pii
from pathweave.llm.common import IdFilter, materialise, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: null texts and texts without a letter. The model learns from the stage's own rows."""
    model = language.train(docs)
    return docs.where(language.predicted(model, F.col("text")) != "und").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id, and one of repeated rows; rows without an id stay."""
    found = materialise(jaccard.near_duplicates(docs, words=5, percent=80).select("doc_id", "component_id"), "pipeline-classes")
    heads = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    losers = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    # only documents that may go, or stand several times, are exchanged
    unsure = IdFilter(losers.union(again))
    kept = unsure.rows(docs, "doc_id").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(unsure.rows(docs, "doc_id", among=False)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or nearly, go."""
    found = materialise(decontaminate.matches(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "pipeline-contaminated")
    some = IdFilter(found)
    kept = some.rows(docs, "doc_id").join(found, "doc_id", "left_anti")
    return kept.unionByName(some.rows(docs, "doc_id", among=False)).select(*COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it become placeholders; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.default_tokenizer()).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
