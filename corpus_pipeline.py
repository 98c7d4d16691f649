"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars); their decisions have taken effect in the rows. Other
columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram, packing, queries, spread, substring, toxicity
from tidemark.ship import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half; the model learns from the rows of ``labels``.

    Each row is scored by its text alone; null and empty texts have neutral features. Without labels of both classes all stay.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies: 5-word shingles, similarity 0.8 or more.

    Of rows that repeat a doc_id one stays; rows with a null doc_id all stay. Only rows that may go are shuffled.
    """
    ship(spark)
    own = spread.free(docs, "_id")
    found = ngram.classify(docs.select("doc_id", "text"), n=5, percent=80).where("doc_id is not null")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    maybe, kept = spread.split_by(docs, gone, own, gone.count())
    kept = kept.unionByName(maybe.join(gone, F.col("doc_id") == F.col(own), "left_anti"))
    twice = spread.cut(found.groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own))
    rows = twice.count()
    if not rows:
        return kept.select(docs.columns)
    maybe, rest = spread.split_by(kept, twice, own, rows)
    return rest.unionByName(maybe.where("doc_id is not null").dropDuplicates(["doc_id"])).unionByName(maybe.where("doc_id is null")).select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that start earlier too; documents with nothing left go."""
    ship(spark)
    found = substring.dedup_substrings(docs, width=50).where("n_removed = 0 or n_removed < n_words")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Rows that repeat a doc_id go by the most taken of them; null ids count as one."""
    ship(spark)
    return mixing.mixed(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences of at most 2048 ids. A null text is empty; repeated rows are pieces each."""
    ship(spark)
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: SQL can neither train the models nor tokenise; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next one reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, before = spread.table(stage(spark, docs, sf_dir)), docs
        if hasattr(before, "_table"):
            spread.release(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    spread.release(docs)
    return out
