"""A corpus pipeline: each stage takes (spark, docs, sf_dir), and its rows, written as Parquet, are the next one's docs.

1 language_id     rejects documents without a letter and those that no learned language explains
2 line_dedup      removes the lines of repeated windows of three lines
3 simhash_dedup   keeps one document of each component of SimHash near-duplicates
4 suffix_dedup    removes the bytes of repeated 200-byte strings
5 packing         packs what is left into sequences

All stages but the last return the columns of their input. No stage has an oracle in SQL: the first learns a model and the
third follows links to any depth, so tests/llm holds the whole against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inflecta.llm import langid_ppm, line_dedup, packing, simhash, suffix_dedup
from inflecta.llm._common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid_ppm.kept(docs, langid_ppm.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("suffix_dedup", repeats), ("packing", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; tables between stages go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
