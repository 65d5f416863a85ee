"""From documents to training sequences: the stages of a corpus, each one operator's decisions put into effect.

All stages take whole texts, keep all columns of documents whatever their names (all but the last), count a null text as
empty, and give an empty table for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import mixing, neardup, packing, private, quality
from pathloom.llm.common import cut, job, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row by its own text; a null text is judged as an empty one.

    The classifier learns from the labelled rows that are still among docs; without any it accepts everything.
    """
    job(spark)
    return quality.keep(docs, quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"))))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, null ids last.

    Texts without words (null, empty) are in no group and all stay; rows that repeat id and text are a group, and rows of one id
    with different texts are different documents.
    """
    job(spark)
    return neardup.one_of_each(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind and n_chars, where there is one, counted anew.

    Texts without personal data, null included, stay as they are.
    """
    job(spark)
    hidden = private.without_private(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (never, once or twice); a null source is a source.

    A text without words has size 0 and is taken like any row of its source; rows equal in id and text are taken alike.
    """
    job(spark)
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, every row packed for itself; a null or empty text is its end id alone."""
    job(spark)
    return packing.pack(docs).drop("ids_le32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("personal data", hide_private),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
