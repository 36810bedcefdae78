"""Registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import code_oracle, html_text, language_model, licenses, packing, quality, sanitise, vector_codes
from turnstone.llm.common import bucket, stored, table
from turnstone.llm.decontaminate import leaks
from turnstone.llm.embedding_dedup import near_vectors
from turnstone.llm.line_dedup import dedup_lines
from turnstone.llm.near_dedup import near_duplicates
from turnstone.llm.resharding import reshard
from turnstone.llm.whitening import whiten


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words").distinct()


def op2_pivot_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), least=0.93)


def tokenizer_path() -> str:
    """The vocabulary file of the packing query, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), with_ids=False)


def op4_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.digest(sanitise.find_personal_data(table(spark, folder, "documents")))


def op5_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    fold = bucket(F.col("doc_id"), 7)
    return language_model.score(table(spark, folder, "documents"), fold == 2, [fold.isin(0, 1, 3), fold.isin(4, 5, 6)])


def op6_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """The table lies in 8 shards by source, one of them hot; it moves to 8 shards of near-equal bytes."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(8))
    return reshard(table(spark, folder, "documents"), old, 8, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    vectors = stored(quality.with_features(table(spark, folder, "documents")), "vectors")
    held_out = bucket(F.col("doc_id"), 4) == 2
    model = quality.fit(vectors.where(~held_out), table(spark, folder, "labels"))
    scored = vectors.select("doc_id", held_out.alias("held_out"), quality.score_column(model, "x", False).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs, count="removed_lines").select("doc_id", F.col("removed_lines").cast("long").alias("removed_lines"),
                                    F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_crc32"))


def op10_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=4, similarity=0.8)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded = vector_codes.with_label_errors(vector_codes.compress(table(spark, folder, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # it imports the operators, as this module does

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pivot_dedup": op2_pivot_dedup,
    "op3_packing": op3_packing,
    "op4_sanitise": op4_sanitise,
    "op5_log_bilinear": op5_log_bilinear,
    "op6_resharding": op6_resharding,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_html_text": op13_html_text,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op12_vector_codes": code_oracle.SQL}
