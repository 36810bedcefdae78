"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, packing; each stage works on what the last kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents; rows they
reject are gone, and texts they change are changed, `n_chars` with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import packing, quality
from turnstone.llm.common import bucket, stored, table
from turnstone.llm.decontaminate import without_leaks
from turnstone.llm.line_dedup import dedup_lines
from turnstone.llm.near_dedup import keep_one

ACCEPTED = 0.7


def tokenizer_path() -> str:
    """The packing vocabulary, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.7 go; where the labels don't hold both classes, none goes."""
    vectors = stored(quality.with_features(docs), "vectors")
    model = quality.fit(vectors.where(bucket(F.col("doc_id"), 4) != 2), table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, "text", True) >= ACCEPTED) if model.separates else docs


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that resemble earlier ones go; documents stay, with an empty text at worst."""
    cut = dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return cut
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.coalesce(size, F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", accept_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack_windows),
]

#: Scores, signatures and token ids can't be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
