"""Operators and stages on odd tables: empty ones, nulls in any column, repeated rows, ties, very long texts, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import digest, langid, licenses, mixing, ngram, packing, pages, repetition, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def scored(docs):
    return toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))))


OPERATORS = {
    "ngram": lambda docs: ngram.classify(docs, 4, 85),
    "substring": substring.substring_digest,
    "passages": substring.dedup_substrings,
    "draw": mixing.draw,
    "pages": lambda docs: pages.extract(docs.withColumnRenamed("text", "html")),
    "language": lambda docs: langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang"), per_language=20)),
    "quality": repetition.quality,
    "fingerprints": digest.fingerprints,
    "neighbours": digest.neighbour_report,
    "licenses": licenses.scan,
    "toxicity": scored,
}
#: names that operators use inside
CLASHES = ["_id", "_hit", "_copies", "_copy", "_part", "_word", "_piece", "_value", "places", "part", "guest", "word", "words", "found", "rules", "standing", "base", "n", "rep", "block", "anchor", "size", "score", "labels", "h1", "component_id"]


def odd(spark):
    long = " ".join(f"w{i * i % 4999}" for i in range(150_000)) + " " + "x" * 300_000 + " " + "same " * 3000
    rows = [(1, "one text here", "en", "a", 5), (1, "one text here", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no id at all here", "en", None, 3), (None, None, None, None, None), (4, long, "de", "b", len(long))]
    rows += [(10 + i, "tie words of equal texts in many rows, fine " * 3, "en" if i % 2 else "fr", "ab"[i % 2], 9) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_rows(spark, name):
    docs = odd(spark)
    docs = docs.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in docs.columns]).repartition(3)
    rows = OPERATORS[name](docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, None, *range(10, 22)}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_of_odd_rows(spark):
    docs = odd(spark)
    rows = packing.pack(docs.withColumn("part", F.lit(1)).withColumn("length", F.lit(2)), PATH).collect()
    assert sorted((r.doc_id or -1) for r in rows if r.piece == 0) == sorted((r.doc_id or -1) for r in docs.collect())
    assert sum(r.length for r in rows if r.doc_id == 4) > 150_000 and packing.pack(docs.limit(0), PATH).count() == 0


def test_held_out_is_never_null(spark):
    assert [r.x for r in spark.createDataFrame([(None,), (1,)], "doc_id long").select(langid.held_out(F.col("doc_id")).alias("x")).collect()].count(None) == 0


def test_language_sample_is_bounded(spark):
    rows = [(5, f"ba do ki {i}", "aa", "s", 1) for i in range(300)] + [(i, f"xe lo mi {i}", "bb", "s", 1) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["lang"]: r["count"] for r in langid.sampled(docs, 5).groupBy("lang").count().collect()}["bb"] == 5
    assert langid.sampled(docs, 5).where("lang = 'aa'").count() <= 1


def test_ties_of_the_mix(spark):
    docs = spark.createDataFrame([(i % 4, "a b", None, "s", 3) for i in range(40)], SCHEMA)
    first, second = (sorted(map(tuple, mixing.draw(docs.repartition(k)).collect())) for k in (1, 5))
    assert first == second and sum(r[4] for r in first) == 40


@pytest.mark.parametrize("rows", [0, 19])
def test_stages(spark, tmp_path, rows):
    docs = odd(spark).limit(rows).select("*", *[F.lit(7).alias(c) for c in ("_id", "_hit", "_copies", "_copy")])
    docs.select("doc_id", F.lit(0).alias("toxic")).where("doc_id is not null").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == (rows > 0)
