"""A corpus pipeline of five operators, each stage written as Parquet and read again by the next.

Every stage takes any table with doc_id, text, lang and source and keeps further columns, whatever
their names, but for the last, whose columns are its own. No rows give no rows. Texts are taken
whole however long. What each stage does with nulls, ties and repeats stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxelloom.llm import langid, mixing, packing, pii, shared, simhash
from voxelloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a language is identified.

    Null texts and texts without a letter go, as do those whose best language has a posterior below
    0.5; without labelled rows all go. Repeated rows stay or go together; ties go to the language
    that sorts first.
    """
    ship(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates.

    It is the one with the smallest doc_id, nulls last; of several such rows one stays. Null and
    wordless texts are one group.
    """
    ship(spark)
    return simhash.keep_one_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind.

    Every row stays; null texts stay null; of overlapping spans the first is replaced. n_chars is
    set anew.
    """
    ship(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out sources to their target weights.

    One row for each document and epoch in which words of it are taken. Null or wordless texts give
    none; a null source is one of its own; repeated rows are taken together. n_chars is set anew.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixed documents into token windows.

    One row for each piece. A null or empty text is its end id alone; rows that share a doc_id are
    packed each for itself; a long document takes many windows.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("packing", pack)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
