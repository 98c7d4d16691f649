"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Method: pieces are dealt evenly into parts and each part is packed by best-fit decreasing. Dual feasible functions give
a lower bound on a part's number of bins; a part at its bound is certified and final, but for its emptiest bin, since a
sum of bounds can be above the bound of all. The other parts' bins with gaps give their pieces back; these are dealt anew
over fewer parts, so that parts exchange documents, and are packed again, until all are certified together by the bound of
all these pieces, fit in one part, or a round saves no bin. A part holds at most ``PART`` pieces. Each piece tells the
surplus over the bound of the part that it was packed in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel
from tidemark.llm.spread import cut, release, sweep, table
from tidemark.llm.tokens import encoder

CAPACITY, PART, _CHARS = 2048, 40_000, 1 << 19


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of dual feasible functions: long lengths round up to a bin, short ones down to nothing."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """``lower_bound`` from the number of pieces of each length from 0 to ``capacity``."""
    words = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    number = np.concatenate([[0], np.cumsum(count)])
    best = -(-int(words[-1]) // capacity)
    for edge in range(1, capacity // 2 + 1):  # over capacity - edge: a bin; under edge: nothing
        large = number[-1] - number[capacity - edge + 1]
        best = max(best, int(large) - (-int(words[capacity - edge + 1] - words[edge]) // capacity))
    for k in range(1, 20):  # x (k + 1) if whole, else its floor, over k
        y = (k + 1) * np.arange(capacity + 1)
        share = np.where(y % capacity == 0, y / ((k + 1) * capacity), (y // capacity) / k)
        best = max(best, int(np.ceil((count * share).sum() - 1e-6)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each length's bin and offset, and the bins' free space."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    have, free = 0, []  # bit f of have: a bin with f free
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = have >> x
        if fits:
            f = x + (fits & -fits).bit_length() - 1
            b = open_by[f].pop()
            if not open_by[f]:
                have &= ~(1 << f)
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - f
        free[b] = f - x
        if f > x:
            open_by[f - x].append(b)
            have |= 1 << (f - x)
    return bins, offsets, np.array(free, np.int64)


def _cut_pieces(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            texts, ids = batch["text"].fill_null("").to_pylist(), batch["doc_id"].to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo + 1, len(texts[lo])
                while hi < len(texts) and held + len(texts[hi]) <= _CHARS:
                    held += len(texts[hi])
                    hi += 1
                tokens, bounds = encoder(path).encode(texts[lo:hi])
                out: list[list] = [[] for _ in names]
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(tokens[a:b], 0).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    at = [0, *range(first, len(own) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        for column, value in zip(out, (ids[lo + i], k, s, e - s, zlib.crc32(own[s:e].tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names)
                lo = hi

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long"


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, surplus long, loose boolean"


def _packer(round_: int, capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        part = group["part"][0].as_py()
        bins, offsets, free = best_fit(lengths, capacity)
        surplus = len(free) - lower_bound(lengths, capacity)
        # a bin is loose if its gap could hold the part's shortest piece, or is over a hundredth of it
        loose = free > min(int(lengths.min()), capacity // 100)
        if not surplus:  # certified: only its emptiest bin may still be filled up
            loose &= np.arange(len(free)) == free.argmax()
        ids = (round_ << 50) + (part << 24) + bins
        out = group.drop_columns(["part"])
        for name, value in (("sequence_id", ids), ("offset", offsets), ("surplus", np.full(len(bins), surplus)), ("loose", loose[bins])):
            out = out.append_column(name, pa.array(value))
        return out

    return pack


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the token ids of each row of ``docs`` (doc_id, text), then id 0: only longer ones are cut, shortest first.

    A null text counts as empty: one piece, of id 0. Null doc_ids stay null; rows that repeat are pieces of their own.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    run, schema = _cut_pieces(path, capacity)
    return docs.select(F.expr("try_cast(doc_id as bigint)").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset (see ``pieces_of``) and surplus.

    Pieces of a sequence lie without gaps from offset 0 and hold at most ``capacity`` ids. surplus is by how many
    sequences the part that the piece was packed in is over its lower bound, 0 where the bound certifies it. Columns of
    ``docs`` other than doc_id and text are not read; a doc_id that is not a whole number counts as null.
    """
    spark = docs.sparkSession
    made = table(pieces_of(docs, path, capacity))
    columns = [*made.columns, "sequence_id", "offset", "surplus"]
    zero = F.lit(0).cast("long")
    full = made.where(f"length = {capacity}").withColumn("sequence_id", F.monotonically_increasing_id() + (1 << 62)).withColumn("offset", zero).withColumn("surplus", zero)
    rest, done, kept, before, round_ = made.where(f"length < {capacity}"), [full], [], None, 0
    while n := rest.count():
        round_ += 1
        parts = -(-n // PART)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(parts)))
        packed = table(dealt.groupBy("part").applyInArrow(_packer(round_, capacity), _PACKED))
        kept.append(packed)
        sweep(spark)
        now = packed.agg(F.countDistinct("sequence_id").alias("all"), F.countDistinct(F.when(F.col("loose"), F.col("sequence_id"))).alias("loose")).first()
        if before is not None and now["all"] >= before[0]:  # nothing is gained
            done.append(before[1])
            break
        again = packed.where("loose")
        count = np.zeros(capacity + 1, np.int64)
        for length, many in again.groupBy("length").count().collect():
            count[length] = many
        # at the bound the loose bins are certified together: no round can do better
        if parts == 1 or now["loose"] <= (bound_of(count, capacity) if count.any() else 0):
            done.append(packed.select(columns))
            break
        done.append(packed.where("not loose").select(columns))
        rest, before = again.select(made.columns), (now["loose"], again.select(columns))
    out = done[0].select(columns)
    for more in done[1:]:
        out = out.unionByName(more)
    out = cut(out)
    release(made, *kept)
    return out
