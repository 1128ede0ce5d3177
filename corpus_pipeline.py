"""A training corpus from raw documents: quality filter, near-duplicates, secrets, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next; each works on all that its predecessor kept. All but the last return the columns of docs. Documents may have null ids, null,
empty or very long texts, repeated rows and further columns of any names; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import common, compression, mixing, packing, secrets, simhash
from kinweave.sources import tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score 0.3 or more); it learns from the labelled ones outside its held-out fold.

    A null text is scored as an empty one; repeated rows and rows with null ids are judged each; equal texts are judged alike.
    Without labels of both kinds all documents get the share of good labels as their score (one half without any), so all stay.
    """
    labels = common.documents(spark, sf_dir, "labels")
    return compression.keep_good(docs, compression.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose sets of five-word shingles are estimated at a similarity of 0.8 or more, and what these link.

    The least id of a group stays; of rows that repeat an id one stays; rows with null ids all stay; null and empty texts are alike.
    """
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of each secret; n_chars is not changed. Null texts stay null; all rows stay, repeated ones too."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; that on a source's border gives its first words that fit.

    Null and empty texts have no words and go; a null source is a source of its own; repeated rows are taken each by itself.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids; each id of each row lies in one piece. A null text is packed as an empty one, its closing id alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secret_scan),
    ("mix", mix),
    ("pack", pack),
]

#: Trained dictionaries and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder, so that a lost executor repeats one stage at most. A result goes when the next is written."""
    folder, before = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                tables.remove(spark, before)
            before = path
    return docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
