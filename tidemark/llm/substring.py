"""Substring dedup: words covered by a window of consecutive words that also starts earlier are removed.

Method: difference-cover anchors. Of a text's positions only those whose remainder modulo a period lies in a difference
cover are hashed, as anchors of ``width - period + 1`` words. Two equal windows of ``width`` words share an anchor at
the same place in both, so a window that holds no repeated anchor needs no look. Around repeated anchors the match is
extended to whole windows, which are compared by 128 bits of hash; each window's first start stays. Rows of one doc_id
are one document: of a window that several of them hold, the first start in each row stays.

Whole texts that repeat an earlier one are set aside first, by 128 bits of hash: all their windows start earlier.
No pairs are made: an anchor or window that occurs k times costs k rows. Texts are read again (and only where a small
bitmap says that something may repeat) instead of being shuffled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernel
from tidemark.llm.spread import free, maybe_in, release, split_by, sweep, table

#: Perfect difference sets: each distance modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(width: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for windows of ``width`` words."""
    period = max((p for p in COVERS if width - p + 1 >= max(1, width // 3)), default=1)
    return period, COVERS.get(period, (0,)), width - period + 1


def _starts(texts: kernel.Words, length: int) -> np.ndarray:
    """Whether a run of ``length`` words starts at each word and ends in the same text."""
    place = np.arange(len(texts.start)) - np.repeat(texts.bounds[:-1], texts.count)
    return place + length <= np.repeat(texts.count, texts.count)


def _places(texts: kernel.Words) -> np.ndarray:
    return np.arange(len(texts.start)) - np.repeat(texts.bounds[:-1], texts.count)


@kernel.tidy
def _identities(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in rows:
        body, offsets = kernel.utf8(batch["text"])
        for a, b in kernel.chunks(offsets):
            texts = kernel.Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            h1, h2 = (pa.array(kernel.signed(x)) for x in kernel.sequences(texts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(texts.count.astype(np.int64)), h1, h2], ["doc_id", "n", "h1", "h2"])


def _anchors(width: int, passes=None):
    """Anchors with their places, or without ``passes``, which says what anchors may be repeated, the anchors alone."""
    period, cover, length = cover_for(width)
    member = np.zeros(period, bool)
    member[list(cover)] = True

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            body, offsets = kernel.utf8(batch["text"])
            ids = np.asarray(batch["doc_id"])
            for a, b in kernel.chunks(offsets):
                texts = kernel.Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = kernel.windows(texts.ids(), length)
                place = _places(texts)[: len(hashes)]
                enough = np.repeat(texts.count >= width, texts.count)[: len(hashes)]
                at = np.flatnonzero(member[place % period] & _starts(texts, length)[: len(hashes)] & enough)
                anchors = hashes[at] >> np.uint64(14)
                if passes is None:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(anchors))], ["anchor"])
                    continue
                keep = passes(anchors)
                at, anchors = at[keep], anchors[keep]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(anchors)), pa.array(ids[a:b][texts.text_of()[at]]), pa.array(place[at].astype(np.int32))], ["anchor", "doc_id", "place"])

    return run, "anchor long" if passes is None else "anchor long, doc_id long, place int"


def _candidates(width: int):
    """Hashes of the windows that hold a repeated anchor (``places`` are the anchors' places), and whether the text has them earlier too."""
    _, _, length = cover_for(width)

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            body, offsets = kernel.utf8(batch["text"])
            ids = np.asarray(batch["doc_id"])
            column = batch["places"]
            flat, cuts = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            for a, b in kernel.chunks(offsets):
                texts = kernel.Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = len(texts.start)
                if n < width:
                    continue
                word = texts.ids()
                own = flat[cuts[a] : cuts[b]] + np.repeat(texts.bounds[:-1], np.diff(cuts[a : b + 1]))
                # a window that starts at s holds the anchor at p if p - (width - length) <= s <= p
                held = np.zeros(n + 1, np.int32)
                np.add.at(held, np.maximum(own - (width - length), np.repeat(texts.bounds[:-1], np.diff(cuts[a : b + 1]))), 1)
                np.add.at(held, own + 1, -1)
                first = kernel.windows(word, width, 1)
                at = np.flatnonzero((np.cumsum(held)[: len(first)] > 0) & _starts(texts, width)[: len(first)])
                if not len(at):
                    continue
                first, second, text = first[at], kernel.windows(word, width, 2)[at], texts.text_of()[at]
                order = np.lexsort((at, second, first, text))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(first)), pa.array(kernel.signed(second)), pa.array(ids[a:b][text]), pa.array(_places(texts)[at].astype(np.int32)), pa.array(again)], ["h1", "h2", "doc_id", "place", "again"])

    return run, "h1 long, h2 long, doc_id long, place int, again boolean"


def removed_places(docs: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, places): the starts of windows of ``width`` words that also start earlier; and their number.

    places is [-1] where all words go. What repeats is counted first, with partial sums, and written; places then join
    with it by plain equi-joins, so that the rows of a key that many texts share are split over tasks at run time.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    known = table(docs.mapInArrow(_identities, "doc_id long, n long, h1 long, h2 long").where(f"n >= {width}"))
    first = table(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last"))
    copies = table(known.join(first, ["h1", "h2", "n"]).where("doc_id <> rep").select("doc_id").distinct())
    maybe, rest = split_by(docs, copies, "doc_id", copies.count())
    docs = rest.unionByName(maybe.join(copies, "doc_id", "left_anti"))
    release(known, first)
    del known, first, maybe, rest
    sweep(spark)

    def repeats() -> DataFrame:
        run, schema = _anchors(width)
        twice = table(docs.mapInArrow(run, schema).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"))
        sweep(spark)
        run, schema = _anchors(width, maybe_in(twice, "anchor", twice.count(), hashes=True).holder())
        out = table(docs.mapInArrow(run, schema).join(twice, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places")))
        release(twice)
        return out

    by_doc = repeats()
    sweep(spark)

    def later() -> DataFrame:
        run, schema = _candidates(width)
        found = table(split_by(docs, by_doc, "doc_id", by_doc.count())[0].join(by_doc, "doc_id").mapInArrow(run, schema))
        sweep(spark)
        once = found.where("not again")
        shared = table(once.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last"))
        sweep(spark)
        gone = once.join(shared, ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "place").unionByName(found.where("again").select("doc_id", "place"))
        gone = gone.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
        out = table(gone.unionByName(copies.selectExpr("doc_id", "array(-1) as places")))
        release(found, shared, copies)
        return out

    gone = later()
    release(by_doc)
    sweep(spark)
    return gone, gone.count()


def _clean(width: int, digest: bool, passed: list[str]):
    """Cuts the covered words. digest: the query's columns; else the text without them and otherwise unchanged."""

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            body, offsets = kernel.utf8(batch["text"])
            column = batch["places"].fill_null([])
            flat, cuts = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            for a, b in kernel.chunks(offsets):
                texts = kernel.Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = len(texts.start)
                own, owner = flat[cuts[a] : cuts[b]], np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                held = np.zeros(n + width + 1, np.int32)
                np.add.at(held, texts.bounds[owner] + np.maximum(own, 0), 1)
                np.add.at(held, np.where(own < 0, texts.bounds[owner + 1], texts.bounds[owner] + own + width), -1)
                keep = np.cumsum(held)[:n] == 0
                whole = texts.body.tobytes()
                gone = texts.count - np.diff(np.concatenate([[0], np.cumsum(keep)])[texts.bounds])
                texts_out, hashes = [], []
                start, end = texts.start, texts.end
                for i in range(b - a):
                    lo, hi = texts.bounds[i], texts.bounds[i + 1]
                    if digest:
                        if gone[i]:
                            k = np.flatnonzero(keep[lo:hi]) + lo
                            kept = b" ".join([whole[s:e] for s, e in zip(start[k].tolist(), end[k].tolist(), strict=True)])
                        else:
                            kept = b" ".join(whole[texts.offsets[i] : texts.offsets[i + 1]].translate(_BLANK).split())
                        hashes.append(hashlib.sha256(kept).hexdigest())
                    elif gone[i]:
                        k = keep[lo:hi]
                        # runs of kept words; each goes with the white space before its first word
                        on = np.flatnonzero(np.diff(np.concatenate([[False], k, [False]]).astype(np.int8)))
                        parts = [whole[(end[lo + s - 1] if s else texts.offsets[i]) : (end[lo + e - 1])] for s, e in zip(on[::2].tolist(), on[1::2].tolist(), strict=True)]
                        texts_out.append(b"".join(parts).strip().decode("utf-8", "replace"))
                    else:
                        texts_out.append(batch["text"][a + i].as_py())
                part = batch.slice(a, b - a)
                if digest:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts.count.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*(pa.array(texts_out, pa.string()) if c == "text" else part[c] for c in passed), pa.array(texts.count.astype(np.int64)), pa.array(gone.astype(np.int64))], [*passed, "n_words", "n_removed"])

    return run


_BLANK = bytes.maketrans(bytes([9, 10, 11, 12, 13]), b" " * 5)


def _split(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with the column places; only rows that may lose words are shuffled."""
    gone, rows = removed_places(docs, width)
    hit, rest = split_by(docs, gone, "doc_id", rows)
    name = free(docs, "_id")
    own = gone.withColumnRenamed("doc_id", name)
    return hit.join(own, F.col("doc_id").cast("long") == F.col(name), "left").drop(name).unionByName(rest.withColumn("places", F.lit(None).cast("array<int>")))


def dedup_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` (doc_id, text and any others) without repeated passages, with n_words and n_removed.

    Every word covered by a window of ``width`` words that also starts earlier (smaller doc_id, or the same document
    and an earlier start) is cut out of ``text``; other characters stay as they are. Null and empty texts, texts with
    fewer than ``width`` words and rows with a null doc_id lose nothing. Rows that repeat a doc_id count as the same
    document: none of them is earlier than the other. Columns named like the operator's own are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "places")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return _split(docs, width).mapInArrow(_clean(width, False, docs.columns), schema)


def substring_digest(docs: DataFrame, width: int = 20) -> DataFrame:
    """Per document doc_id, n_words, n_removed and the SHA-256 of its kept words joined by one space.

    Nulls and repeated rows are treated as in ``dedup_substrings``; a null text has no words.
    """
    docs = docs.select("doc_id", "text")
    return _split(docs, width).mapInArrow(_clean(width, True, []), "doc_id long, n_words long, n_removed long, kept_sha256 string")
