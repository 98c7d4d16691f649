"""FNV-1a and trigram sketches of many texts at once, in NumPy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X

# The hash's start and prime.
START, PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Hashes are kept as signed numbers of the same order.
FLIP = np.uint64(1 << 63)
_CHUNK = 1 << 20


def fnv(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a of the byte ranges of ``body``: byte by byte for all that are long enough, the longest few one by one."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    out = np.full(len(at), START, np.uint64)
    active = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")
    for k, n in enumerate(active.tolist()):
        if n < 16:
            for i in range(n):
                h = int(out[i])
                for b in body[at[i] + k : at[i] + left[i]].tolist():
                    h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
                out[i] = h
            break
        out[:n] = (out[:n] ^ body[at[:n] + k]) * np.uint64(PRIME)
    hashes = np.empty_like(out)
    hashes[order] = out
    return hashes


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def fnv1a_long(texts: Column) -> Column:
    """FNV-1a of whole texts as 16 hex digits, in Arrow batches; ``functions.text.fnv1a`` is for short strings."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        body, offsets = _utf8(batch)
        hashes = fnv(body, offsets[:-1], np.diff(offsets))
        return pa.array([None if null else f"{h:016x}" for h, null in zip(hashes.tolist(), batch.is_null().to_pylist(), strict=True)], pa.string())

    return run(texts)


def hex_of(sketched: Column) -> Column:
    """A hash of a sketch as 16 hex digits."""
    return F.lpad(F.lower(F.hex(sketched.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


def trigram_sketches(body: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distinct hashes of the trigrams of texts whose tokens are parted by one space: hashes and bounds."""
    rows = len(offsets) - 1
    blank = np.ones(len(body) + 2, bool)
    blank[1:-1] = body == 32
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(~blank[1:] & (blank[:-1] | edge))
    end = np.flatnonzero(~blank[:-1] & (blank[1:] | edge))
    owner = np.searchsorted(offsets, first, "right") - 1
    n = len(first) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    whole = np.flatnonzero(owner[:n] == owner[2:])
    hashes = fnv(body, first[whole], end[whole + 2] - first[whole])
    own = owner[whole]
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])]) if len(own) else np.zeros(0, bool)
    own, hashes = own[new], hashes[new]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    own, hashes = own[rank < k], hashes[rank < k]
    return (hashes ^ FLIP).view(np.int64), np.searchsorted(own, np.arange(rows + 1))


def with_sketches(rows: DataFrame, text: str, name: str, k: int) -> DataFrame:
    """``rows`` with the column ``name`` in place of ``text``: the text's sketch, its tokens being parted by white space."""
    bare = rows.withColumn(text, F.regexp_replace(X.trim(F.col(text)), f"[{X.WS}]+", " "))
    rest = [c for c in rows.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            body, offsets = _utf8(batch[text])
            lo = 0
            while lo < batch.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, "right")) - 1), batch.num_rows)
                hashes, bounds = trigram_sketches(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(own[c] for c in rest), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes))], [*rest, name])
                lo = hi

    return bare.mapInArrow(run, T.StructType([*(rows.schema[c] for c in rest), T.StructField(name, T.ArrayType(T.LongType()))]))
