"""The pipeline over documents: quality, line dedup, near dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, line_dedup, packing, quality, substring_dedup
from millrace.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty tables and rows of null doc_id pass through whole."""
    scored = quality.train_and_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scored.where("predicted = 0").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go from all of them; a text without such lines stays as it is."""
    index = line_dedup.build_index(docs, 10)
    return _documents(line_dedup.drop_frequent_lines(docs, index, carry=["lang", "source"]))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates stays: five words, 0.8 or more."""
    return jaccard_join.near_dedup(docs.select(*COLUMNS), jaccard_join.Measure(5, 80, 100)).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has go; a text that loses nothing keeps its white space."""
    return _documents(substring_dedup.cut_passages(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer stand in the way of SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
