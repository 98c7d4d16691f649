"""Language identification: nearest of several centroids per language, with distance-based rejection.

Method: byte trigrams of lower-cased letters are hashed into ``DIMS`` dimensions, weighted by TF-IDF and normalised.
Spherical k-means gives ``CENTROIDS`` centroids for each language; a text takes the language of its nearest centroid by
cosine. The least similar ``REJECTED`` of a language's training texts set the distance beyond which a text is rejected;
a rejected text keeps its nearest language, with a score under one half.

The model is fitted on at most ``per_language`` texts of each language (those with the smallest hashes of their ids), of
which only count vectors of a fixed size reach the driver. Languages are counted first, so that all but about twice as
many ids are ruled out where they are read. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernel
from tidemark.llm.spread import release, split_by, table

DIMS, CENTROIDS, REJECTED, _ROWS = 1 << 12, 4, 0.01, 256
_LETTER = np.full(256, 32, np.uint8)  # other ASCII counts as a space
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams, one row for each text."""
    rows = len(offsets) - 1
    letter = _LETTER[body]
    space = letter == 32
    keep = np.ones(len(body), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(body)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    letter = letter[keep].astype(np.uint32)
    n = len(letter) - 2
    if n <= 0:
        return np.zeros((rows, DIMS), np.float32)
    h = (letter[:n] | letter[1 : n + 1] << np.uint32(8) | letter[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    owner = np.repeat(np.arange(rows), np.diff(at))
    ok = owner[:n] == owner[2:]
    slot = owner[:n] * DIMS + (h >> np.uint32(20)).astype(np.int64)
    return np.bincount(slot[ok], minlength=rows * DIMS).reshape(rows, DIMS).astype(np.float32)


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, names: list[str], edge: np.ndarray):
        self.idf, self.centroids, self.owner, self.names, self.edge = idf, centroids, owner, names, edge

    def predict(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and whether the text is farther than the language's edge."""
        near = weighted(count, self.idf) @ self.centroids.T
        best = np.full((len(near), len(self.names)), -1.0, np.float32)
        for k, lang in enumerate(self.owner):
            best[:, lang] = np.maximum(best[:, lang], near[:, k])
        lang = best.argmax(axis=1)
        top = best[np.arange(len(best)), lang]
        rest = best.copy()
        rest[np.arange(len(best)), lang] = -1
        second = np.maximum(rest.max(axis=1), 0) if len(self.names) > 1 else np.zeros(len(best))
        far = top < self.edge[lang]
        sure = 0.5 + 0.5 * np.clip((top - second) / np.maximum(top, 1e-9), 0, 1)
        score = np.where(far, 0.5 * np.clip(top / np.maximum(self.edge[lang], 1e-9), 0, 1) * 0.999, sure)
        return lang, np.clip(score, 0, 1), far


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean and then the rows farthest from those taken."""
    mean = x.mean(axis=0)
    start = [int((x @ mean).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@kernel.tidy
def _vectors(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            body, offsets = kernel.utf8(part["text"])
            for a, b in kernel.chunks(offsets):
                count = np.minimum(counts(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([part["lang"].slice(a, b - a), pa.array([x.tobytes() for x in count], pa.binary())], ["lang", "vector"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id isn't held out, though it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(known: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang) of at most ``per_language`` doc_ids of each language, those with the smallest hashes.

    By a language's number of rows a bound is set that leaves some more than are wanted, whatever the language's share
    of all rows is; only these few are ranked. Where a language's doc_ids repeat much, fewer are left.
    """
    # written, so that the planner knows its size and sends it to the rows, unless languages are very many
    many = table(known.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_rows")))
    most = per_language + 8 * int(per_language**0.5) + 16
    ids = known.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    ids = ids.join(many, F.col("lang") == F.col("_lang")).where(F.expr(f"double(h) * _rows < {most} * 9223372036854775808D")).select("doc_id", "lang", "h").distinct()
    return ids.selectExpr("doc_id", "lang", "row_number() over (partition by lang order by h, doc_id) as r").where(f"r <= {per_language}").select("doc_id", "lang")


def fit(docs: DataFrame, per_language: int = 500) -> Model | None:
    """Learns from ``docs`` (doc_id, text, lang), rows without lang, text or doc_id left out; None if none is left.

    Of rows that repeat a doc_id the one with the smallest lang and text is learned from, if at all.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = table(sampled(known, per_language).select("doc_id").distinct())
    rows = ids.count()  # at most per_language for each language
    maybe, _ = split_by(known.select("doc_id", "text", "lang"), ids, "doc_id", rows)
    one = maybe.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))
    found = one.select("x.lang", "x.text").mapInArrow(_vectors, "lang string, vector binary").toArrow()
    release(ids)
    if not found.num_rows:
        return None
    langs = np.array(found["lang"].to_pylist(), object)
    names = sorted(set(langs))
    x = np.frombuffer(b"".join(found["vector"].to_pylist()), "<u2").reshape(-1, DIMS).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(x, idf)
    centroids, owner, edge = [], [], []
    for k, name in enumerate(names):
        own = x[langs == name]
        c = cluster(own, CENTROIDS)
        centroids.append(c)
        owner += [k] * len(c)
        edge.append(np.quantile((own @ c.T).max(axis=1), REJECTED))
    return Model(idf, np.concatenate(centroids), np.array(owner), names, np.array(edge, np.float32))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text and any others) with lang_pred, score and rejected.

    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with score 0. Only the text is
    read; columns named like the operator's own are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sent = spark.sparkContext.broadcast(model)

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = sent.value
        for batch in rows:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                body, offsets = kernel.utf8(part["text"])
                for a, b in kernel.chunks(offsets):
                    own = part.slice(a, b - a)
                    bytes_, bounds = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    plain = ((bytes_ | 32) >= 97) & ((bytes_ | 32) <= 122)
                    has = np.diff(np.concatenate([[0], np.cumsum(plain)])[bounds]) > 0
                    for i in np.flatnonzero(~has & (np.diff(bounds) > 0)):
                        has[i] = any(c.isalpha() for c in own["text"][int(i)].as_py())
                    if model is None:
                        names, score, far = np.full(b - a, "und", object), np.zeros(b - a), np.zeros(b - a, bool)
                    else:
                        lang, score, far = model.predict(counts(bytes_, bounds))
                        names = np.where(has, np.array(model.names, object)[lang], "und")
                        score, far = np.where(has, score, 0.0), far & has
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names.tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array(far)], [*own.schema.names, "lang_pred", "score", "rejected"])

    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(fields))
