"""The registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import digest, langid, licenses, mixing, ngram, oracles, packing, pages, repetition, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.classify(_table(spark, sf_dir, "documents"), n=4, percent=85).drop("n_copies")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(_table(spark, sf_dir, "documents"), width=20)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer of that name lies; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbour_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_substring_dedup,
        op3_source_mixing,
        op4_html_extraction,
        op5_language_id,
        op6_best_fit_packing,
        op7_quality_rules,
        op8_document_fingerprints,
        op9_license_scans,
        op10_toxicity,
    )
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM,
    "op2_substring_dedup": oracles.SUBSTRING,
    "op3_source_mixing": oracles.MIXING,
}
