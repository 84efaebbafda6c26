"""The registered queries of this folder, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import ann, bpe, fingerprint, jaccard, langid, licenses, lines, mixing, substrings, toxicity
from gossamer.llm._common import fold

#: The vocabulary file that the queries use; a parameter of the operator itself.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null")
    known = labels.where(fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, known)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_encode_decode, op2_nearest_neighbours, op3_line_dedup, op4_language_id, op5_source_mixing, op6_license_scan, op7_jaccard_join, op8_substring_dedup, op9_toxicity, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.ORACLE_SQL, "op5_source_mixing": mixing.ORACLE_SQL, "op8_substring_dedup": substrings.ORACLE_SQL, "op10_fingerprints": fingerprint.ORACLE_SQL}
