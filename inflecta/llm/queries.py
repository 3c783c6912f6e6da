"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inflecta.llm import ann_mih, fingerprint, html_crf, langid_ppm, line_dedup, packing, simhash, spm_codec, suffix_dedup, toxicity_fm
from inflecta.llm._common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"), html_crf.trained())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity_fm.score(documents, toxicity_fm.fit(documents, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid_ppm.predict(documents, langid_ppm.fit(documents))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_mih.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return spm_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_language_id, op4_nearest, op5_suffix_dedup, op6_packing, op7_fingerprints, op8_simhash, op9_sentencepiece, op10_line_dedup)}

ORACLES: dict[str, str] = {"op10_line_dedup": line_dedup.oracle_sql()}
