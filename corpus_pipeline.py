"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing to target weights, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before kept.  ``run``
applies them to the table ``documents``; between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandlens.llm import exact, jaccard, language, mixing, packing
from demandlens.llm.common import Shelf, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Training a network and tokenising have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = read_table(spark, sf_dir, "documents"), Shelf(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shelf.put(docs)
    return docs
