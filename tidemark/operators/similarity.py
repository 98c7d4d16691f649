"""Fingerprints, sketches and redundancy of outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.hashing import fnv1a_long, with_sketches

SKETCH, RECENT, RING, SIMILAR, LENGTHS = 96, 16, 32, 0.85, 0.80


def joined(text: Column) -> Column:
    """A text's lines joined by LF, as outputs are compared."""
    return F.array_join(X.lines(text), "\n")


def fingerprints(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with fp, the FNV-1a of the text's joined lines, short_hash, its first 8 digits, and n_bytes, their length."""
    made = rows.withColumn("_j", joined(F.col(text))).withColumn("fp", fnv1a_long(F.col("_j")))
    return made.withColumn("short_hash", F.left("fp", F.lit(8))).withColumn("n_bytes", F.octet_length("_j").cast("long")).drop("_j")


def sketches(texts: DataFrame, key: str, text: str = "text", k: int = SKETCH) -> DataFrame:
    """(key, sketch): the k smallest FNV-1a hashes of a text's trigrams, as signed numbers of the same order."""
    return with_sketches(texts.select(key, text), text, "sketch", k)


def similar_pairs(sketched: DataFrame, key: str, least: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of keys a < b whose sketches reach ``least``.

    Two sketches that reach ``least`` of their union share one of the first (1 - least) * size + 1 of both in any common
    order. Here the order is from rare hashes to frequent ones, by their number in all sketches, so that few unlike
    sketches meet; and only keys, sizes and places meet, sketches are joined to the pairs that sizes and places allow.
    """
    named = sketched.where(F.size("sketch") > 0).select(F.col(key).alias("id"), "sketch", F.size("sketch").alias("size"))
    each = named.select("id", "size", F.explode("sketch").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # hashes of one sketch only are no one's meeting point, but they keep their places, which come first
    ranked = each.join(often, "h").select("id", "size", "h", "c")
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "h")) + F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    keyed = ranked.withColumn("p", place.cast("int")).where(F.expr(f"p <= size - cast(ceil({least} * size - 1e-9) as int) + 1")).select("id", "size", "h", "p")
    a = keyed.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("p").alias("pa"), "h")
    b = keyed.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("p").alias("pb"), "h")
    # what is shared lies at this place or behind it in both
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    near = a.join(b, "h").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (most * (1 + least) >= least * (F.col("na") + F.col("nb")) - 1e-9))
    pairs = near.select("a", "b").distinct()
    whole = named.select("id", "sketch")
    scored = pairs.join(whole.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(whole.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b").withColumn("similarity", X.jaccard(F.col("sa"), F.col("sb")))
    return scored.where(F.col("similarity") >= F.lit(least).cast("float")).select("a", "b", "similarity")


def exact_repeats(calls: DataFrame, session: str, order: str, text: str, window: int = RECENT) -> DataFrame:
    """Calls with the same output, by fingerprint and length, as one of the ``window`` calls before: the oldest of them, as ref.

    The stateless form of the fold below: every call counts as recorded.
    """
    marked = fingerprints(calls, text).withColumn("_l", F.size(X.lines(F.col(text)))).select(session, order, "fp", "n_bytes", "_l")
    numbered = marked.withColumn("_i", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    same = Window.partitionBy(session, "fp", "n_bytes").orderBy("_i").rangeBetween(-window, -1)
    return numbered.withColumn("ref", F.min(order).over(same)).where(F.col("ref").isNotNull() & (F.col("_l") >= 2)).select(session, order, "ref")


def similar_repeats(calls: DataFrame, session: str, order: str, text: str, window: int = RECENT, least: float = SIMILAR) -> DataFrame:
    """Calls that are similar to one of the ``window`` calls before: the most similar, the oldest of ties, as ref.

    Lengths differ by a fifth at most; output has six lines or more. One pass in order: each call sees a frame of the
    calls before it, so sketches are made once and not joined.
    """
    rows = calls.select(session, order, F.octet_length(text).alias("_n"), F.size(X.lines(F.col(text))).alias("_l"), F.col(text).alias("_t"))
    rows = with_sketches(rows, "_t", "_s", SKETCH)
    ordered = Window.partitionBy(session).orderBy(order)
    rows = rows.withColumn("_i", F.row_number().over(ordered))
    rows = rows.withColumn("_old", F.collect_list(F.struct(F.col(order).alias("ref"), "_i", "_n", "_s")).over(ordered.rowsBetween(-window, -1))).where("_l >= 6")
    ratio = lambda p: (F.least("_n", p["_n"]).cast("float") / F.greatest("_n", p["_n"]).cast("float")).cast("float")
    near = F.filter("_old", lambda p: ratio(p) >= F.lit(LENGTHS).cast("float"))
    scored = F.transform(near, lambda p: F.struct(X.jaccard(F.col("_s"), p["_s"]).alias("similarity"), (-p["_i"]).alias("older"), p["ref"].alias("ref")))
    best = rows.withColumn("_best", F.array_max(F.filter(scored, lambda x: x["similarity"] >= F.lit(least).cast("float")))).where("_best is not null")
    return best.select(session, order, F.col("_best.ref").alias("ref"), F.col("_best.similarity").alias("similarity"))


FOLD = "call_n long, hit_kind string, ref long, similarity double"


class Fold:
    """The redundancy state of one session: hits are not recorded, yet they move the call number."""

    def __init__(self, log: list | None = None, call: int = 0):
        self.log, self.call = log or [], call

    def add(self, order: int, n_lines: int, digest: str, size: int, sketch: list | None) -> tuple:
        self.call += 1
        shingles = frozenset(() if sketch is None else sketch)
        recent = self.log[-RECENT:]
        for n, h, length, _ in recent:
            if n_lines >= 2 and h == digest and length == size:
                return order, "exact", n, None
        best = None
        if n_lines >= 6:
            for n, _, length, other in recent:
                if min(length, size) / max(length, size, 1) >= LENGTHS and shingles and other:
                    j = len(shingles & other) / len(shingles | other)
                    if j >= SIMILAR and (best is None or j > best[1]):
                        best = (n, j)
        if best:
            return order, "similar", best[0], best[1]
        self.log = (self.log + [(order, digest, size, shingles)])[-RING:]
        return order, None, None, None


#: What the fold reads of a call.
MARKS = ["call_n", "n_lines", "fp", "n_bytes", "sketch"]


def marked(calls: DataFrame) -> DataFrame:
    """(session, call_n, n_lines, fp, n_bytes, sketch) of (session, call_n, text); made before calls move, so that texts don't."""
    rows = calls.select("session", "call_n", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprints(rows, "text").withColumn("n_lines", F.size(X.lines(F.col("text"))))
    return with_sketches(rows.select("session", "call_n", "n_lines", "fp", "n_bytes", "text"), "text", "sketch", SKETCH)


def redundancy_fold(calls: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """(session, call_n, hit_kind, ref, similarity): each call against the recorded ones before it, in order.

    What is recorded depends on earlier hits, so a session is folded in order and in one task; its calls' marks are
    sorted by Spark and streamed, and only the last calls are held.
    """
    rows = marked(calls.select(F.col(session).cast("long").alias("session"), F.col(order).cast("long").alias("call_n"), F.col(text).alias("text")))
    laid = rows.repartition("session").sortWithinPartitions("session", "call_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, Fold()
        for batch in batches:
            out = []
            for session, call, *marks in batch[["session", *MARKS]].itertuples(index=False):
                if session != now:
                    now, fold = session, Fold()
                out.append((session, *fold.add(call, *marks)))
            yield pd.DataFrame(out, columns=["session", "call_n", "hit_kind", "ref", "similarity"]).astype({"ref": "Int64"})

    return laid.mapInPandas(run, "session long, " + FOLD)
