"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Method: within a sliding window of five bytes three triplets are hashed into ``BUCKETS`` buckets; each bucket's count is
coded by the quartile it falls in, two bits each, after a head with the length on a logarithmic scale and the quartiles'
ratios. Digests are compared by a bounded score: each bucket adds its distance (0 to 3, a whole swing counted double),
the head adds its own, and likeness is one minus the sum's share of its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernel

BUCKETS = 128
#: Offsets of the triplets in a window, newest byte first.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Distance of two buckets' quartile codes.
STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int32)
#: Most that the head can add: length, and the two ratios.
HEAD = 120
MOST = 6 * BUCKETS + HEAD
_ROWS = 512
#: Ranges of doc_ids at most: so many cuts and first rows' numbers are held by the driver and sent to the executors.
MOST_PARTS = 50_000


def digests(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 3 + BUCKETS / 4 bytes for each text; texts of fewer than three bytes have all counts zero."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int64), size)
    place = np.arange(len(body)) - np.repeat(offsets[:-1], size)
    b = body.astype(np.uint32)
    count = np.zeros(rows * BUCKETS, np.int64)
    for k, triplet in enumerate(TRIPLETS):
        back = triplet[2]
        if len(body) <= back:
            continue
        n = len(body) - back
        h = b[back:] * np.uint32(0x9E3779B1) + b[back - triplet[1] : len(body) - triplet[1]] * np.uint32(0x85EBCA77) + b[:n] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F * (k + 1) % (1 << 32))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(25)).astype(np.int64)
        ok = place[back:] >= back
        count += np.bincount((owner[back:] * BUCKETS + bucket)[ok], minlength=rows * BUCKETS)
    count = count.reshape(rows, BUCKETS)
    ranked = np.sort(count, axis=1)
    q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (count > q[:, :1]).astype(np.uint8) + (count > q[:, 1:2]) + (count > q[:, 2:])
    packed = (code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6).astype(np.uint8)
    length = np.minimum(np.round(8 * np.log2(1 + size)), 255).astype(np.uint8)
    ratio = np.where(q[:, 2:] > 0, np.floor(255 * q[:, :2] / np.maximum(q[:, 2:], 1)), 0).astype(np.uint8)
    return np.concatenate([length[:, None], ratio, packed], axis=1)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference score of digests, row by row: 0 for equal ones, MOST at most."""
    shifts = np.array([0, 2, 4, 6], np.uint8)
    x = (a[:, 3:, None] >> shifts) & 3
    y = (b[:, 3:, None] >> shifts) & 3
    body = STEP[x, y].sum(axis=(1, 2))
    length = np.minimum(np.abs(a[:, 0].astype(int) - b[:, 0]), 60)
    ratios = np.minimum(np.abs(a[:, 1:3].astype(int) - b[:, 1:3]).sum(axis=1) // 4, 60)
    return body + length + ratios


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - differences(a, b) / MOST


def of_texts(texts: list[str]) -> np.ndarray:
    out = [np.zeros((0, 3 + BUCKETS // 4), np.uint8)]
    body, offsets = kernel.utf8(pa.array(texts, pa.large_string()))
    for a, b in kernel.chunks(offsets):
        for lo in range(a, b, _ROWS):
            hi = min(b, lo + _ROWS)
            out.append(digests(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
    return np.concatenate(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any others) with the hex ``fingerprint``; null texts count as empty, equal texts have equal ones."""
    docs = docs.drop("fingerprint")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            found = of_texts(batch["text"].fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes().hex() for x in found], pa.string())], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@kernel.tidy
def _compare(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it in its part; parts are sorted and end with a guest, the next part's first row."""
    held: tuple | None = None
    for batch in rows:
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            part, ids, guest, text = (piece[c].to_pylist() for c in ("part", "doc_id", "guest", "text"))
            if held is not None:
                part, ids, guest, text = [held[0], *part], [held[1], *ids], [held[2], *guest], [held[3], *text]
            held = part[-1], ids[-1], guest[-1], text[-1]
            own = [i for i in range(len(part) - 1) if not guest[i]]
            if not own:
                continue
            changed = [edited(text[i], text[i + 1]) for i in own]
            prints = of_texts(text)
            mine, new, after = prints[own], of_texts(changed), prints[[i + 1 for i in own]]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in own], pa.int64()), pa.array([len(text[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array([x.tobytes().hex() for x in mine]), pa.array([x.tobytes().hex() for x in new]),
                pa.array(likeness(mine, new)), pa.array(likeness(mine, after)),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def neighbour_report(docs: DataFrame, part_bytes: int = 16 << 20, most_parts: int = MOST_PARTS) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The next document is the one after it by descending doc_id, and the first one after the last; null doc_ids come
    last, and rows with one doc_id go by their text. A null text counts as empty; a single document is its own next.
    Texts are shuffled once: doc_ids are cut into ranges of about ``part_bytes`` of text, one to a task, and each range
    gets, as a guest, the row that comes after its last one. Large tables have larger ranges, ``most_parts`` in number
    at most, so that what the driver holds and sends of them, a few numbers each, is bounded; a range is sorted with
    spilling and read in small batches. Very long texts are held a few at a time. Columns other than doc_id and text
    are not read; a doc_id that is not a whole number counts as null.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = docs.select(F.expr("try_cast(doc_id as bigint)").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("named")).first()
    if not total["n"]:
        return spark.createDataFrame([], _OUT)
    parts = max(1, min(most_parts, int(total["bytes"]) // part_bytes))
    # cuts by rank: all of a doc_id's rows are on one side
    cuts = sorted(set(docs.where("doc_id is not null").select("doc_id").stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 and total["named"] else []
    edges = [int(x) for x in cuts]
    # part 0 holds the largest doc_ids; null doc_ids go to the last
    last = len(edges)
    bounds = spark.sparkContext.broadcast(np.array(edges, np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        named = ids.notna()
        at = last - np.searchsorted(bounds.value, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(named, at, last)).astype("int32")

    dealt = docs.withColumn("part", part("doc_id"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()
    wanted = spark.createDataFrame([(h["part"], h["doc_id"]) for h in heads], "part int, top long")
    tops = dealt.join(F.broadcast(wanted), (dealt["part"] == wanted["part"]) & dealt["doc_id"].eqNullSafe(wanted["top"])).groupBy(dealt["part"].alias("part")).agg(F.min("text").alias("text"))
    # parts in use are numbered without gaps: each goes to the task of its number
    places = {h["part"]: k for k, h in enumerate(heads)}
    moved = spark.createDataFrame([(p, k, (k - 1) % len(heads)) for p, k in places.items()], "part int, place int, prior int")
    guests = tops.join(F.broadcast(moved), "part").select(F.col("prior").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("guest"))
    own = dealt.join(F.broadcast(moved), "part").select(F.col("place").alias("part"), "doc_id", "text", F.lit(False).alias("guest"))
    laid = own.unionByName(guests).repartitionById(len(heads), F.col("part")).sortWithinPartitions("part", "guest", *order)
    return laid.mapInArrow(_compare, _OUT)
