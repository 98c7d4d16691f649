"""N-gram Jaccard join and its classes: which documents share enough of their word n-grams.

Method: the document by n-gram incidence matrix is multiplied with its transpose in blocks. The n-grams' hash space is
cut into column blocks; how many follows from the sizes: two sets of at most U n-grams that reach the threshold differ
in at most D(U) of them, so of D(U) + 1 + spare blocks at least spare + 1 are equal, and pairs without an equal block
are discarded unseen. For the rest, overlap counts are accumulated over both documents' sparse rows and pairs below the
bound that their sizes give are discarded.

Frequent n-grams would make unlike documents share blocks. The n-grams of a text that fall into a crowded hash cell,
counted over all texts, are therefore set aside as one block more, which the spare blocks pay for; the other blocks then
hold an n-gram that few documents have. A document with more empty blocks than spare ones, since nearly all its n-grams
are frequent, meets others of its kind by prefix: ordered with the rare n-grams first, two sets that reach the threshold
share one of the first few of both, and what lies behind it bounds their overlap. So nothing is lost.

Equal sets are joined first, by hash, as one node. Then three rounds find the links that matter for the classes: each
document with the smallest document that shares a block; the other smallest ones; and all pairs that share a block and
are not yet in one class. A class of k copies so takes about k tests. Before a test, parities of n-gram counts in as many
cells as n-grams rule out pairs that surely differ too much. Sets are 54-bit hashes of the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel
from tidemark.llm.spread import components, cut, release, split_by, sweep, table

BITS = np.uint64(54)
MASK = np.uint64((1 << 54) - 1)
#: Hash cells in which n-grams are counted; crowded ones hold this many documents more than chance lets one expect.
CELLS, CROWD, RANGES = 1 << 20, 64, 64
#: Spare blocks for each block that the bound asks for.
SPARE = 0.2
ROWS = 1 << 9  # texts in a chunk; with 54 bits of hash they fit one sort key


def sets(texts: kernel.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, and the bounds of each text's."""
    ids, rows = texts.ids(), len(texts.count)
    owner = texts.text_of()
    grams = kernel.windows(ids, n) >> np.uint64(10)
    place = np.arange(len(ids)) - np.repeat(texts.bounds[:-1], texts.count)
    whole = place[: len(grams)] + n <= np.repeat(texts.count, texts.count)[: len(grams)]
    keys = [(owner[: len(grams)][whole].astype(np.uint64) << BITS) | grams[whole]]
    for few in range(1, n):
        at = texts.bounds[:-1][texts.count == few]
        if len(at):
            keys.append((owner[at].astype(np.uint64) << BITS) | (kernel.windows(ids, few, few)[at] >> np.uint64(10)))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & MASK, np.searchsorted(key >> BITS, np.arange(rows + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def _texts(rows: Iterable[pa.RecordBatch]):
    for batch in rows:
        ids = np.asarray(batch["doc_id"])
        for at in range(0, batch.num_rows, ROWS):
            body, offsets = kernel.utf8(batch["text"].slice(at, ROWS))
            for a, b in kernel.chunks(offsets):
                yield ids[at + a : at + b], kernel.Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)


def _identities(n: int):
    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for ids, texts in _texts(rows):
            grams, bounds = sets(texts, n)
            h1, h2 = (_sums(kernel.mix(grams, s), bounds) for s in (3, 4))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(bounds).astype(np.int64)), pa.array(kernel.signed(h1)), pa.array(kernel.signed(h2)), pa.array(_parities(grams, bounds), pa.binary())], _IDENTITY_NAMES)

    return run


_IDENTITY_NAMES = ["doc_id", "n", "h1", "h2", "parity"]
_IDENTITY = "doc_id long, n long, h1 long, h2 long, parity binary"


def _parities(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, the parity of the number of its n-grams in each of 64, 128, ... cells, at least as many as n-grams.

    The xor of two sets' parities has a one for at most each n-gram in which they differ. Halves of more cells fold by
    xor into fewer.
    """
    sizes = np.diff(bounds)
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(cells)])
    at = np.repeat(base[:-1], sizes) + (grams.astype(np.int64) & (np.repeat(cells, sizes) - 1))
    bits = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
    packed, cut_at = np.packbits(bits, bitorder="little").tobytes(), (base // 8).tolist()
    return [packed[a:b] for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]


def _differ_little(percent: int):
    """Keeps the pairs whose parities don't show more differences than their sizes allow."""

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y, nx, ny in zip(*(batch[c].to_pylist() for c in ("parity_a", "parity_b", "n_a", "n_b")), strict=True):
                cells = 8 * min(len(x), len(y))
                x, y = _folded(x, cells), _folded(y, cells)
                keep.append((100 + percent) * (x ^ y).bit_count() <= (100 - percent) * (nx + ny))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _folded(x: bytes, cells: int) -> int:
    value, have = int.from_bytes(x, "little"), 8 * len(x)
    while have > cells:
        have //= 2
        value = (value >> have) ^ (value & ((1 << have) - 1))
    return value


@lru_cache
def classes(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes: first sizes, the number of blocks for pairs whose larger set is in the class, and spare ones.

    Sets that reach the threshold are in the same class or in neighbouring ones.
    """
    first = [1]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
    first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
    largest = np.array(first[1:]) - 1
    differ = (100 - percent) * 2 * largest // (100 + percent)
    spare = np.where(differ > 0, np.ceil(SPARE * differ), 0).astype(np.int64)
    return np.array(first), np.where(differ > 0, differ + 1 + spare, 0), spare


def _cells(n: int):
    """Counts by cell over a part of the texts, as rows (range, counts)."""

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        count = np.zeros(CELLS, np.uint32)
        for _, texts in _texts(rows):
            count += np.bincount((sets(texts, n)[0] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        if count.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array([x.tobytes() for x in count.reshape(RANGES, -1)], pa.binary())], ["range", "counts"])

    return run


@kernel.tidy
def _summed(group: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in group:
        for at, counts in zip(batch["range"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            total[at] = total.get(at, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
    for at, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["range", "counts"])


def crowded(docs: DataFrame, n: int) -> np.ndarray:
    """Which cells are crowded: more documents than the mean, six deviations of chance and CROWD allow."""
    spark = docs.sparkSession
    parts = docs.mapInArrow(_cells(n), "range int, counts binary").repartition(16, "range")
    found = parts.mapInArrow(_summed, "range int, counts binary").toArrow()
    count = np.zeros((RANGES, CELLS // RANGES))
    for at, counts in zip(found["range"].to_pylist(), found["counts"].to_pylist(), strict=True):
        count[at] += np.frombuffer(counts, np.uint64)
    count = count.ravel()
    # the median, since frequent n-grams themselves raise the mean
    usual = float(np.median(count))
    sweep(spark)
    return count > usual + 6 * np.sqrt(usual) + CROWD


_BLOCK = "block long, doc_id long, n int, p int"


def _blocks(n: int, percent: int, frequent):
    """Rows (block hash, doc_id, n, p): each document's column blocks, for its own size class and the next, or its prefix.

    p is the n-gram's place in its document's order, 0 for a block.
    """

    def batch_of(block, ids, sizes, place):
        return pa.RecordBatch.from_arrays([pa.array(kernel.signed(block)), pa.array(ids), pa.array(sizes.astype(np.int32)), pa.array(place.astype(np.int32))], ["block", "doc_id", "n", "p"])

    def cut_up(ids, sizes, grams, bounds, kind, count):
        """One class's cut of sorted ``grams``: rows to emit, and how many blocks of each document are empty."""
        doc = np.repeat(np.arange(len(sizes)), np.diff(bounds))
        weights = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(grams, 5), dtype=np.uint64)])
        total = int(count.sum())
        base = np.concatenate([[0], np.cumsum(count)])
        used = count[doc] > 0
        # hashes are sorted within a text, so blocks are runs
        slot = base[doc[used]] + (((grams[used] >> np.uint64(22)) * count[doc[used]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(len(sizes)), count)
        ends = bounds[owner] + np.cumsum(held) - np.concatenate([[0], np.cumsum(held)])[base[owner]]
        value = weights[ends] - weights[ends - held]
        level = kind[owner].astype(np.uint64) << np.uint64(32)
        block = kernel.mix(value ^ kernel.mix(level | (np.arange(total) - base[owner]).astype(np.uint64), 6), 7)
        full, own = held > 0, owner[held > 0]
        return batch_of(block[full], ids[own], sizes[own], np.zeros(len(own))), np.bincount(owner[~full], minlength=len(sizes))

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for ids, texts in _texts(rows):
            grams, bounds = sets(texts, n)
            sizes = np.diff(bounds)
            first, blocks, spare = classes(percent, 1 << int(max(4, sizes.max(initial=1))).bit_length())
            own = np.searchsorted(first, sizes, "right") - 1
            rare = ~frequent.value[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
            run_of = np.concatenate([[0], np.cumsum(rare)])
            rare_bounds = run_of[bounds]
            poor = np.zeros(len(sizes), bool)
            for kind in (own, own + 1):
                at = np.maximum(kind, 0)
                count = np.where(sizes > 0, blocks[at], 0)
                if count.any():
                    batch, empty = cut_up(ids, sizes, grams[rare], rare_bounds, kind, count)
                    poor |= empty > spare[at]
                    yield batch
            if poor.any():
                doc = np.repeat(np.arange(len(sizes)), sizes)
                before = run_of[:-1] - rare_bounds[doc]  # rare n-grams of the document before this one
                place = np.where(rare, before, (rare_bounds[1:] - rare_bounds[:-1])[doc] + np.arange(len(grams)) - bounds[doc] - before)
                keep = poor[doc] & (place < (sizes - -(-sizes * percent // 100) + 1)[doc])
                yield batch_of(kernel.mix(grams[keep], 11), ids[doc[keep]], sizes[doc[keep]], place[keep])

    return run


def _rows(n: int):
    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for ids, texts in _texts(rows):
            grams, bounds = sets(texts, n)
            data = grams.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([data[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "grams"])

    return run


def _overlaps(percent: int):
    """Accumulates overlap counts over the sparse rows of a batch of pairs; keeps pairs at their bound or above."""

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys, lengths = [], []
                for side in ("grams_a", "grams_b"):
                    sparse = part[side].to_pylist()
                    size = np.array([len(x) // 8 for x in sparse])
                    keys.append(np.frombuffer(b"".join(sparse), "<u8") | (np.repeat(np.arange(len(sparse)), size).astype(np.uint64) << BITS))
                    lengths.append(size)
                key = np.sort(np.concatenate(keys))
                both = np.bincount((key[1:][key[1:] == key[:-1]] >> BITS).astype(np.int64), minlength=part.num_rows)
                union = lengths[0] + lengths[1] - both
                yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (union > 0)))

    return run


def _links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    a = rows.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a"))
    b = rows.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b"))
    near = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "grams_a", "grams_b")
    return near.mapInArrow(_overlaps(percent), "a long, b long")


def _likely(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out."""
    a = prints.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    b = prints.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    near = pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    return table(near.mapInArrow(_differ_little(percent), "a long, b long").distinct())


def _sparse_rows(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The sparse rows (doc_id, grams) of the documents in ``pairs``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    maybe, _ = split_by(docs, wanted, "doc_id", wanted.count())
    return table(maybe.join(wanted, "doc_id", "left_semi").mapInArrow(_rows(n), "doc_id long, grams binary").distinct())


def _rooted(df: DataFrame, roots: DataFrame, *names: str) -> DataFrame:
    for x in names:
        df = df.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    return df


def _fits(percent: int) -> str:
    """The bounds from sizes: their ratio, and the overlap that is possible from the shared n-gram's places on."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(na - pa, nb - pb) >= {percent} * (na + nb)"


def classify(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and n_copies.

    Sets of distinct ``n``-word shingles link when their Jaccard similarity is at least ``percent`` per cent; texts with
    fewer words are one shingle; texts without words have an empty set, link with nothing and form their own class.
    component_id is the smallest doc_id that links reach. n_copies counts the rows with the very same set. A row with
    a null doc_id gets a null component_id and links with nothing. Rows that repeat a doc_id are one document: what
    one of them links with, all do. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id is not null")
    found = table(named.mapInArrow(_identities(n), _IDENTITY))
    # written first, so that the join back is a plain one, whose large classes are split over tasks at run time
    same = table(found.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")))
    known = table(found.drop("parity").join(same, ["h1", "h2", "n"], "left").selectExpr("doc_id", "n", "coalesce(rep, doc_id) as rep", "coalesce(n_copies, 1L) as n_copies"))
    copies = table(known.where("doc_id <> rep").select("doc_id").distinct())
    maybe, rest = split_by(named, copies, "doc_id", copies.count())
    own = known.where("doc_id = rep").select("doc_id").distinct()
    unlike = rest.unionByName(maybe.join(own, "doc_id", "left_semi"))
    release(same)
    del same
    sweep(spark)

    frequent = spark.sparkContext.broadcast(crowded(unlike, n))

    def blocks() -> DataFrame:
        made = unlike.mapInArrow(_blocks(n, percent, frequent), _BLOCK)
        order = "over (partition by block order by doc_id rows between unbounded preceding and current row)"
        return table(made.selectExpr("block", "doc_id as b", "n as nb", "p as pb", f"first_value(doc_id) {order} as a", f"first_value(n) {order} as na", f"first_value(p) {order} as pa").where("a <> b"))

    shared = blocks()
    sweep(spark)
    # first the documents against the smallest one of each of their blocks
    stars = table(shared.where(_fits(percent)).select("a", "b").distinct())
    likely = _likely(stars, found, percent)
    rows = _sparse_rows(unlike, likely, n)
    nearest = likely.groupBy("b").agg(F.min("a").alias("a"))
    several = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    alike = known.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = table(_links(nearest, rows, percent).unionByName(alike))
    roots = components(links)
    others = _rooted(likely.join(nearest, ["a", "b"], "left_anti"), roots, "a", "b").where("root_a <> root_b").select("a", "b")
    more = table(_links(others, rows, percent))
    sweep(spark)
    # then all pairs across classes within the blocks whose documents are in several classes
    roots = components(links.unionByName(more))
    inside = shared.select("block", "b", "nb", "pb").unionByName(shared.select("block", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("pa").alias("pb")).distinct())
    inside = _rooted(inside, roots, "b")
    split = inside.groupBy("block").agg(F.min("root_b").alias("x"), F.max("root_b").alias("y")).where("x <> y").select("block")
    inside = table(inside.join(split, "block", "left_semi"))
    left = inside.select("block", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("pb").alias("pa"), F.col("root_b").alias("root_a"))
    across = left.join(inside, "block").where("a < b and root_a <> root_b").where(_fits(percent)).select("a", "b").distinct()
    unsure = _likely(across.join(stars, ["a", "b"], "left_anti"), found, percent)
    rest_rows = _sparse_rows(unlike, unsure, n)
    last = table(_links(unsure, rest_rows, percent))
    roots = components(links.unionByName(more).unionByName(last))
    out = cut(known.join(roots.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("doc_id", "n as n_shingles", "coalesce(root, rep) as component_id", "n_copies"))
    release(found, known, copies, shared, stars, likely, rows, links, more, inside, unsure, rest_rows, last)
    sweep(spark)
    unnamed = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_identities(n), _IDENTITY).selectExpr("cast(null as long) as doc_id", "n as n_shingles", "cast(null as long) as component_id", "1L as n_copies")
    return out.unionByName(unnamed)
