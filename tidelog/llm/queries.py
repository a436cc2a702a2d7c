"""The queries opN_<name> of this subpackage and their SQL: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm.wavelet import documents, write

    return documents(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.graphs import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.lines import without_boilerplate

    d = without_boilerplate(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.ann import search

    d = table(spark, sf_dir, "embeddings")
    return search(d, d.where("vec_id % 20 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm.pieces import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_wavelet, op2_graphs, op3_extract, op4_simhash, op5_lines, op6_ann, op7_warc, op8_toxicity, op9_mixing, op10_pieces)}


def oracle_sql() -> dict[str, str]:
    from tidelog.llm.oracle import SQL

    return dict(SQL)
