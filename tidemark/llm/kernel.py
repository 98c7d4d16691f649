"""NumPy kernels over Arrow string buffers: words, 64-bit word ids and rolling window hashes.

Everything works on UTF-8 bytes of many texts at once. Chunks hold whole texts of about ``CHUNK`` bytes together,
so memory follows the longest single text, never the size of a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _libc(name: str):
    return getattr(ctypes.CDLL(None), name, None)


# arrays of a megabyte and more are the system's again as soon as they are freed, in each worker that imports this
if _libc("mallopt") is not None:
    _libc("mallopt")(-3, 1 << 20)


def give_back() -> None:
    """Returns what this process holds of freed memory to the system, where its C library can do so."""
    pa.default_memory_pool().release_unused()
    if _libc("malloc_trim") is not None:
        _libc("malloc_trim")(0)


def tidy(run: Callable[..., Iterable[pa.RecordBatch]]) -> Callable[..., Iterable[pa.RecordBatch]]:
    """A function over batches that leaves its worker, which may idle beside others, without freed memory."""

    @wraps(run)
    def wrapped(*rows) -> Iterable[pa.RecordBatch]:
        try:
            yield from run(*rows)
        finally:
            give_back()

    return wrapped


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = -(-n // (1 << 14)) << 14
        up = np.full(m, base, np.uint64)
        down = np.full(m, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if m <= 2 * CHUNK:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of whole texts, each of about ``limit`` bytes, and one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte starts and ends, bounds by text, and 64-bit ids."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, lower: bool = False, sep: np.ndarray = _SEP):
        self.body = body = _LOWER[body] if lower else body
        self.offsets = offsets
        n = len(body)
        word = np.zeros(n + 2, bool)
        np.logical_not(sep[body], out=word[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        self.end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        self.start = self.start[self.start < n]
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)

    def ids(self) -> np.ndarray:
        up, down = powers(len(self.body) + 1)
        run = np.zeros(len(self.body) + 1, np.uint64)
        np.cumsum((self.body.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        return mix((run[self.end] - run[self.start]) * down[self.start])

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(ids: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` ids; runs that start in the last width - 1 places are left out."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(ids) + 1, (_P + 2 * 0x632BE59BD9B4E019 * (seed + 1)) % (1 << 64) | 1)
    run = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * up[:-1], out=run[1:])
    return mix((run[width:] - run[:n]) * down[:n], seed)


def sequences(texts: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each text's word sequence."""
    ids = texts.ids()
    up, down = powers(len(ids) + 1)
    out = []
    for seed in (8, 9):
        run = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids, seed) * up[: len(ids)], out=run[1:])
        out.append(mix((run[texts.bounds[1:]] - run[texts.bounds[:-1]]) * down[np.minimum(texts.bounds[:-1], len(ids))], seed))
    return out[0], out[1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
