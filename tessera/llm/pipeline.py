"""A corpus from raw documents to packed training sequences: five stages, each a single operator of this subpackage.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each as Parquet in the shared folder and
reads it back as the next stage's input. All but the last return the columns of ``documents``. Mixing repeats a document
as rows of its own, one for each epoch that takes it; packing then keeps the copies in different bins.

Defined results, beyond those of the operators: a null or empty text has no language, so the first stage rejects it; of
equal texts, also with null or repeated ids, one row stays; columns beyond those of ``documents`` are carried through all
stages but the last, whatever their names; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import durable, table
from .exact_dedup import drop_exact_duplicates
from .language_id import keep_identified
from .mixing import mix, repeat_documents
from .near_copies import drop_near_duplicates
from .packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_documents(docs, mix(docs, partial=False))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language identification, near duplicates and packing cannot be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
