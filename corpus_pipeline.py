"""A training-data pipeline over `documents`: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes each result to the
shared scratch folder and reads it back for the next stage.

Edge cases: documents without text, or without a letter in it, have no language and go in the first stage; texts of any
length are read whole; null ids, languages and sources stay null, and a null source is a source of the mix; repeated rows
are near duplicates of each other, so one stays; of equal candidates the stage's operator tells which one, by
id and hash, and reruns agree; an empty table gives an empty mix; columns other than those of documents are
left out, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from leafmill.llm.common import drop_scratch, materialize, read, scratch_mark

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language gets this mean probability of its words.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or with no leading language go."""
    told = language_id.predict(docs, language_id.train(docs))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated runs of lines; n_chars follows the text. All documents stay."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages, by the operator's rule for documents."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies: how often each is to be repeated."""
    return mixing.mixed_documents(docs).select(*COLUMNS, "copies")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", cut_repeated_lines),
    ("ngram_join", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: Language ID can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = read(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_scratch(mark, but=docs)  # the stage's own tables, and its input
    return docs
