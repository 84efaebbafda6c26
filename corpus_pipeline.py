"""A training corpus from documents, in five stages that each work on all that the one before kept.

The stages fit what they need (language profiles, token counts) on their own
input. All but the last return the columns of documents; the text that line
dedup shortens has its n_chars counted anew. Mixing repeats a document as many
times as the mixture has it. The last returns the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import bpe, jaccard, langid, lines, mixing
from gossamer.llm._common import fold, unused, written
from gossamer.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a known language: no letter, nothing in common with the nearest profile, or a score far below all labelled rows of its language."""
    profiles = langid.fit(docs.where(fold("doc_id", 3) != 1))
    # where nothing could be learned, nothing is rejected
    if not profiles.langs:
        return docs
    # written, so that no text is predicted twice
    lang, score = unused(docs, "told_lang", "told_score")
    told = written(langid.predict(docs, profiles, pred=lang, score=score), "told")
    least = langid.least_scores(told, score=score)
    return told.where(langid.accepted(lang, score, least=least)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.remove_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.digests(docs, VOCABULARY, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_tokens", tokens),
]

#: Rank-order profiles, connected components and merges by rank are beyond one SQL statement; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
