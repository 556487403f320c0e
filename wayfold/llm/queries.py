"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import fingerprint, hard_negatives, html_text, media, mixing, near_dup, packing, piece_bpe, ranked_search, secrets, sharding, toxicity, url_filter


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.op11_ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": _over("pages", html_text.op1_html_text),
    "op2_secret_scan": _over("documents", secrets.op2_secret_scan),
    "op3_fingerprint": _over("documents", fingerprint.op3_fingerprint),
    "op4_packing": _over("documents", packing.op4_packing),
    "op5_url_filter": _over("pages", url_filter.op5_url_filter),
    "op6_media": _over("documents", media.op6_media),
    "op7_near_dup": _over("documents", near_dup.op7_near_dup),
    "op8_toxicity": _toxicity,
    "op9_sharding": _over("documents", sharding.op9_sharding),
    "op10_mixing": _over("documents", mixing.op10_mixing),
    "op11_ranked_search": _ranked_search,
    "op12_piece_tokens": _over("documents", piece_bpe.op12_piece_tokens),
    "op13_hard_negatives": _over("embeddings", hard_negatives.op13_hard_negatives),
}

ORACLES: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_ranked_search": ranked_search.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
