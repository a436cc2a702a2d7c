"""A corpus pipeline out of the operators in tidelog.llm.

Stages take (spark, docs, sf_dir) and return documents with their columns, the last one what it tells
of each. Each stage's result is a Parquet table in the shared folder and the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Swept, scratch, table
from tidelog.llm.lines import without_boilerplate
from tidelog.llm.mixing import mix
from tidelog.llm.pieces import fingerprints
from tidelog.llm.simhash import near_duplicates
from tidelog.llm.toxicity import scored
from tidelog.session import discard, ship


def _same(docs: DataFrame, ids: DataFrame):
    """Rows of docs and ids (doc_id, mark) that are one document: equal ids and texts, nulls included."""
    return docs["doc_id"].eqNullSafe(ids["_id"]) & (docs["_mark"] == ids["_text"])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts are scored as texts without words; repeated rows go or stay together; an empty table stays empty, and without labels of both kinds nothing goes."""
    ship(spark)
    d = docs.withColumn("_mark", F.xxhash64("text"))
    bad = scored(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_text"))
    return d.join(bad, _same(d, bad), "left_anti").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources hold go from all documents but the first; documents of nothing but such lines go with them. Null and blank texts stay as they are; see without_boilerplate for ties and repeats."""
    d = without_boilerplate(docs)
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    d = d.where((F.col("n_removed") == 0) | ~blank)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id. Texts without words are one group; equal rows are one; a null doc_id stays."""
    ship(spark)
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_text"))
    d = docs.withColumn("_mark", F.xxhash64("text"))
    return d.join(kept, _same(d, kept), "left_semi").dropDuplicates(["doc_id", "_mark"]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, the nearest number to the words it takes. Documents without words, null ones too, are taken no time; repeated rows are documents of their own."""
    d = mix(docs, carry=docs.columns)
    return d.where("copies > 0").select("carried", F.explode(F.sequence(F.lit(1), "copies"))).select("carried.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of ids and decoded text, of every document."""
    import public_tokenizers

    ship(spark)
    return fingerprints(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicate", near_duplicate), ("mixing", mixing), ("pieces", pieces)]

#: SimHash, TF-IDF neighbours and piece encoding are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages. What a stage wrote for itself goes when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Swept(spark) as made:
            path = scratch(spark, f"stage-{name}")
            made.keep.add(path)
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
