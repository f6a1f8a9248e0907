"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roundlens.llm.decontaminate import drop_contaminated
from roundlens.llm.jaccard_join import drop_near_copies
from roundlens.llm.piece_codec import encode_pieces
from roundlens.llm.quality import drop_low_quality
from roundlens.llm.textkit import clear, stage, staged
from roundlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network finds toxic go.

    Null and empty texts score 0 and stay; long texts are scored to their end; repeated rows and equal scores are judged alike; an empty table stays empty; other columns pass.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go; a document's site is its source, its path the language section there.

    Null sources and languages are a site and a path of their own; null and empty texts are judged by their path; repeated rows count each; an empty table stays empty; other columns pass.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "source", "lang")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Null doc_ids, and null and empty texts, stay; rows that repeat a doc_id stay or go together; an empty table stays empty; other columns pass.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; long texts are searched to their end; repeated rows are judged alike; without items, or without documents, nothing changes; other columns pass.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of all documents that are left, checked by decoding them.

    Null and empty texts have none and come back as empty; long texts are encoded whole; repeated rows are encoded each; an empty table stays empty; other columns aren't returned.
    """
    return encode_pieces(docs).select("doc_id", "lang", "source", "n_tokens", "token_ids", "roundtrip")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: No SQL: SQL doesn't express training a network or encoding into pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; what a stage wrote for itself goes once its result is written, and its input with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, step in STAGES:
        first = len(staged)
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        done = staged[first:-1]
        before = [*before, *done, staged[-1]]
        clear(spark, before[:-1])
        before = before[-1:]
    return docs
