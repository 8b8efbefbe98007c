"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.importance import resample
from quadloom.llm.packing import pack_documents
from quadloom.llm.simhash import similar_documents
from quadloom.llm.substring import remove_repeats
from quadloom.plans.lineage import fresh_path

CAPACITY = 4096


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    _, keep = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates: five-word shingles, similarity 0.8. Rows of that id all stay."""
    groups = similar_documents(docs)
    gone = groups.where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of sentences and lines that an earlier document holds; n_chars follows the text."""
    names = docs.columns
    clean = remove_repeats(docs, spans="_removed")
    counted = F.when(F.size("_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", counted).select(*names) if "n_chars" in names else clean.select(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, with_ids=False).drop("ids")


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("substring dedup", repeats), ("best-fit packing", packing)]

#: Gumbel sampling, fingerprints, sentence units and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
