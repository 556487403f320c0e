"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, secrets are masked, sources are mixed, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.mixing import mixed_texts
from wayfold.llm.near_dup import one_of_each
from wayfold.llm.packing import op4_packing
from wayfold.llm.scratch import saved
from wayfold.llm.secrets import mask_secrets
from wayfold.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score under the toxicity threshold. Null and empty texts, rows without doc_id and repeated rows stay; without usable labels all stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of documents at a similarity of 0.8 or more. Texts without words and rows without doc_id stay; of rows with one doc_id one stays."""
    return one_of_each(docs, 80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in every text and set n_chars; null and empty texts and all other rows and columns stay as they are."""
    return mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents whole, none to three times, so that sources come near their target weights; null is a source, texts without words are never taken, equal rows are taken alike."""
    return mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Return the packed pieces of all documents; null and empty texts are one token, the end of a document."""
    return op4_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages' models, signatures and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stored before the next; return the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
