"""Helpers that keep work spread out: checkpoints, bounded id bitmaps, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.kernel import give_back
from tidemark.sources.shared import file_system, shared_folder

#: Bits of the largest bitmap that is sent to the executors (8 MB); beyond it more rows pass, none is lost.
MAX_BITS = 1 << 26


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to spark.checkpoint.dir, which all executors share, and reads it from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` written as compressed columns in the shared folder and read from there.

    ``release`` removes it; what a result still reads, or a failed query left, goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    at, files = file_system(spark, path)
    files.deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that nothing will read again."""
    for df in tables:
        at, files = file_system(df.sparkSession, df._table)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bit(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def maybe_in(ids: DataFrame, name: str, rows: int, hashes: bool = False) -> "Bitmap":
    """A bitmap of hashed ids, sized by ``rows`` up to MAX_BITS: it lets every id of ``ids`` pass, and few others.

    hashes: the ids are hashes themselves, as ``Bitmap.holds`` takes them.
    """
    bits = 1 << 16
    while bits < min(16 * max(rows, 1), MAX_BITS):
        bits <<= 1
    at = F.pmod(F.col(name), F.lit(bits)) if hashes else _bit(F.col(name), bits)
    found = (
        ids.select(at.alias("at")).selectExpr("cast(at div 32 as int) as w", "shiftleft(1L, cast(at % 32 as int)) as b")
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    words = np.zeros(bits // 32, np.uint32)
    words[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return Bitmap(ids.sparkSession, words, bits)


class Bitmap:
    def __init__(self, spark: SparkSession, words: np.ndarray, bits: int):
        self.bits, self.words = bits, spark.sparkContext.broadcast(words)

    def test(self, column: Column) -> Column:
        words = self.words

        @F.arrow_udf("boolean")
        def hit(at: pa.Array) -> pa.Array:
            a = at.to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.array((words.value[a >> 5] >> (a & 31).astype(np.uint32)) & np.uint32(1) == 1)

        return hit(_bit(column, self.bits))

    def holder(self):
        """A function for the workers: which of some hashes pass."""
        words, mask = self.words, np.uint64(self.bits - 1)

        def holds(hashes: np.ndarray) -> np.ndarray:
            at = hashes.astype(np.uint64) & mask
            return (words.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1

        return holds


def split_by(docs: DataFrame, ids: DataFrame, name: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may be among ``ids`` (few others with them), and those that are surely not. Nothing is shuffled."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    hit = free(docs, "_hit")
    marked = docs.withColumn(hit, maybe_in(ids, name, rows).test(key))
    return marked.where(F.col(hit)).drop(hit), marked.where(~F.col(hit)).drop(hit)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root being the smallest node id.

    Large-star and small-star rounds: each node's neighbours move to its smallest neighbour until nothing changes.
    Minima are partially aggregated before the shuffle and joined back, so no neighbourhood is collected in one place.
    Nodes without an edge are not returned.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def summary(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = summary(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = summary(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def sweep(spark: SparkSession) -> None:
    """Lets the driver forget finished plans, so that executors delete their shuffle files now and not some day.

    What this process holds of freed arrays goes back to the system too, where its C library can do so.
    """
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def batches(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)
