"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

Method: an event is the next byte of a word (or its end) after the last ``DEPTH`` bytes at most, all along the word. Each
class has its own counts of events, discounted by ``DISCOUNT`` (by how often they were seen: once, twice, more); what the
discount frees goes to the class's next shorter context, whose counts are of the different bytes seen before it (contexts
from a word's start have none and keep plain counts). Without any context both classes lean on one shared distribution:
how many contexts a byte follows in either class, and 1/256. A text's features are the mean over its words (longer ones in
pieces of ``PIECE`` bytes) of the difference of both classes' log-likelihoods, the share that words beyond ``STRONG`` have
in it, the largest means over runs of ``RUNS`` words, and its largest word. A logistic curve over them, fitted on training
rows that were not counted, gives the score.

Counts cover all training rows but the at most ``FIT_ROWS`` of the curve, and grow with the vocabulary of these rows. Up
to ``TABLE_EVENTS`` different events, ratios are kept by 64-bit keys in a sorted table that has all events and contexts that
change a score, and is sent to the executors. Beyond that nothing is sent: events stay dealt out by the last two bytes of
their contexts; the distinct words of the texts are asked there, and their values go to the texts that hold them, which are
shuffled once. Both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernel
from tidemark.llm.langid import _LETTER
from tidemark.llm.spread import free, release, split_by, sweep, table

DEPTH, DISCOUNT, RUNS, STRONG = 8, (1.0, 1.3, 1.5), (12, 50, 200), 2.0
#: What stands for a word's start and end; longer words are so many bytes a piece where features are gathered.
_EDGE, PIECE = 32, 24
_SPACE = np.zeros(256, bool)
_SPACE[_EDGE] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(DEPTH + 1)], np.uint64)
#: Rows of the logistic fit: a bounded sample, by hash of their ids.
FIT_ROWS = 20_000
#: Events of a task that makes ratios of them, and events that a task counts before it hands them on.
_EVENTS, _HELD = 500_000, 1 << 19
#: Different events of the largest table that is sent to the executors (about 12 bytes each), and bytes of text to a task beyond it.
TABLE_EVENTS, PART_BYTES = 1 << 22, 16 << 20


class Spelled:
    """Words of lower-cased letters: each one's number among the distinct ones, and these ones' events, word by word.

    An event is a byte (or the end) and its context, up to DEPTH bytes packed with the last one lowest; a word's start
    is a byte of the context too. ``begin`` has the first event of each distinct word.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        self.texts = texts = kernel.Words(_LETTER[body], offsets, sep=_SPACE)
        self.id, first, self.number = np.unique(texts.ids(), return_index=True, return_inverse=True)
        self.start = start = texts.start[first]
        self.size = texts.end[first] - start
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)])
        self.place = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], self.size + 1)
        at = np.repeat(start, self.size + 1) + self.place
        padded = np.append(texts.body, np.uint8(_EDGE))
        self.byte = np.where(self.place == np.repeat(self.size, self.size + 1), _EDGE, padded[at]).astype(np.uint64)
        self.context = np.zeros(len(at), np.uint64)
        for k in range(1, DEPTH + 1):
            before = np.where(self.place >= k, padded[np.maximum(at - k, 0)], np.where(self.place == k - 1, _EDGE, 0))
            self.context |= before.astype(np.uint64) << np.uint64(8 * (k - 1))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word's pieces, and the first event of each piece: a word's end belongs to its last one."""
        return -(-self.size // PIECE), np.flatnonzero((self.place % PIECE == 0) & (self.place < np.repeat(self.size, self.size + 1)))


def _lengths(context: np.ndarray) -> np.ndarray:
    return np.sum([context > m for m in _MASKS[:-1]], axis=0) if len(context) else np.zeros(0, np.int64)


def keyed(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """64 bits for an event; byte 0 for what a context leaves to bytes unseen after it."""
    return kernel.mix(kernel.mix(context, 1) + byte.astype(np.uint64), 2)


@kernel.tidy
def _events(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counted events of the training rows: context, byte, and both classes' counts, summed over ``_HELD`` events at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged() -> Iterable[pa.RecordBatch]:
        context, byte, tally = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, first, at = np.unique(keyed(context, byte), return_index=True, return_inverse=True)
        both = [np.bincount(at, weights=tally[:, k], minlength=len(first)).astype(np.int64) for k in (0, 1)]
        context, byte = kernel.signed(context[first]), byte[first].astype(np.int16)
        for lo in range(0, len(first), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (context, byte, *both)], ["context", "byte", "c0", "c1"])

    for batch in rows:
        body, offsets = kernel.utf8(batch["text"])
        label = np.asarray(batch["toxic"]).astype(np.int64)
        for a, b in kernel.chunks(offsets):
            words = Spelled(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(words.number):
                continue
            of = label[a:b][words.texts.text_of()]
            tally = np.stack([np.bincount(words.number[of == k], minlength=len(words.size)) for k in (0, 1)], axis=1).astype(np.int32)
            held.append((words.context, words.byte.astype(np.uint8), np.repeat(tally, words.size + 1, axis=0)))
            size += len(words.context)
            if size > _HELD:
                yield from merged()
                size = 0
    if held:
        yield from merged()


class Model:
    """Log-likelihood ratios by 64-bit key, in order of the keys, found from their leading bits on."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratio = np.append(keys[order], np.uint64(2**64 - 1)), np.append(ratio[order], np.float32(0)).astype(np.float32)
        self.shift = 64 - max(len(keys).bit_length(), 1)
        self.first = None
        #: beyond TABLE_EVENTS: the table of events, and what longer contexts lean on
        self.events: DataFrame | None = None
        self.short = np.zeros(0)
        self.weights = self.mean = np.zeros(0)
        self.scale = np.ones(0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"first": None, "events": None}  # each worker makes its own index

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each key, 0 where it is missing, and whether it is there."""
        if self.first is None:
            starts = np.arange(1 << (64 - self.shift), dtype=np.uint64) << np.uint64(self.shift)
            self.first = np.searchsorted(self.keys[:-1], starts).astype(np.int32 if len(self.keys) < 1 << 31 else np.int64)
        at = self.first[(key >> np.uint64(self.shift)).astype(np.int64)].astype(np.int64)
        late = np.flatnonzero(self.keys[at] < key)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] < key[late]]
        hit = self.keys[at] == key
        return np.where(hit, self.ratio[at], 0), hit

    def words(self, words: Spelled) -> np.ndarray:
        """The ratio of each event of some words."""
        return self.ratios(words.context, words.byte, np.minimum(words.place + 1, DEPTH))

    def ratios(self, context: np.ndarray, byte: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ratio of each event: the longest known context's, and what longer ones leave to unseen bytes."""
        out = np.zeros(len(byte))
        at = np.arange(len(out))
        while len(at):
            ratio, hit = self.look(keyed(context, byte))
            out[at] += ratio
            at, length, context, byte = at[~hit], length[~hit], context[~hit], byte[~hit]
            out[at] += self.look(keyed(context, np.zeros_like(byte)))[0]
            more = length > 0
            at, length, context, byte = at[more], length[more] - 1, context[more], byte[more]
            context = context & _MASKS[length]
        return out

    def pieces(self, words: Spelled) -> np.ndarray:
        """The log-likelihood ratio of each piece of each word; contexts reach over the bounds of pieces."""
        _, head = words.pieces()
        return np.add.reduceat(self.words(words), head) if len(head) else np.zeros(0)

    def features(self, body: np.ndarray, offsets: np.ndarray, valued: Callable[[Spelled], np.ndarray] | None = None) -> np.ndarray:
        words = Spelled(body, offsets)
        texts, number = words.texts, words.number
        rows = len(offsets) - 1
        pieces, _ = words.pieces()
        value = (valued or self.pieces)(words)
        before = np.concatenate([[0], np.cumsum(pieces)])
        many = pieces[number]
        upto = np.concatenate([[0], np.cumsum(many)])
        each = np.clip(value, -12, 12)[np.repeat(before[number] - upto[:-1], many) + np.arange(upto[-1])] if len(number) else np.zeros(0)
        bounds = upto[texts.bounds]
        count = np.diff(bounds)
        owner = np.repeat(np.arange(rows), count)
        run = np.concatenate([[0.0], np.cumsum(each)])
        lo, hi = bounds[:-1], bounds[1:]
        out = [(run[hi] - run[lo]) / np.maximum(hi - lo, 1)]
        place = np.arange(len(each)) - np.repeat(lo, count)
        for width in RUNS:
            # runs end inside the text; the first ones are shorter and count as if filled up with neutral words
            begin = np.arange(len(each)) - np.minimum(place, width - 1)
            best = np.zeros(rows)
            if len(each):
                np.maximum.at(best, owner, (run[1:] - run[begin]) / width)
            out.append(best)
        strong = np.concatenate([[0.0], np.cumsum(np.maximum(each - STRONG, 0))])
        out.append((strong[hi] - strong[lo]) / (hi - lo + 30))
        top = np.zeros(rows)
        if len(each):
            np.maximum.at(top, owner, each)
        out.append(top)
        out.append(np.where(count > 0, 1.0, 0.0))
        return np.stack(out, axis=1)


def curved(features: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores on the logistic curve."""
    z = ((features - mean) / scale) @ weights[1:] + weights[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 0.1) -> np.ndarray:
    """Weights by Newton's method, the bias first and without penalty."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _discount(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 0, 0.0, np.where(c == 1, DISCOUNT[0], np.where(c == 2, DISCOUNT[1], DISCOUNT[2])))


def _shares(group: np.ndarray, groups: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By event (its context's number, counts by class): what discounts leave of its share; by context: what they free."""
    kept, freed = np.zeros(n.shape), np.ones((groups, 2))
    for k in (0, 1):
        total = np.bincount(group, weights=n[:, k], minlength=groups)
        off = _discount(n[:, k])
        on = total > 0
        freed[on, k] = np.bincount(group, weights=off, minlength=groups)[on] / total[on]
        kept[:, k] = (n[:, k] - off) / np.maximum(total[group], 1)
    return kept, freed


def _entries(context: np.ndarray, byte: np.ndarray, p: np.ndarray, kept: np.ndarray, each: np.ndarray, freed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ratios of events and contexts, without those that a look-up adds up to the same without.

    An event of which discounts leave nothing has the ratio of an unseen one, and a context that leaves both classes'
    unseen bytes the same share has ratio 0.
    """
    own = kept.any(axis=1)
    left = _log_ratio(freed)
    return np.concatenate([keyed(context[own], byte[own]), keyed(each, np.zeros_like(each))[left != 0]]), np.concatenate([_log_ratio(p[own]), left[left != 0]])


def _log_ratio(p: np.ndarray) -> np.ndarray:
    return (np.log(np.maximum(p[:, 1], 1e-12)) - np.log(np.maximum(p[:, 0], 1e-12))).astype(np.float32)


def _short(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities by last byte and byte (for the longer contexts to lean on), and the keys and ratios of contexts of a byte and none.

    The shortest leans on one distribution for both classes: how many contexts a byte follows, and 1/256 for bytes unseen.
    """
    n = np.zeros((1 << 16, 2))
    n[found["last"].to_numpy() * 256 + found["byte"].to_numpy()] = np.stack([found["n0"].to_numpy(), found["n1"].to_numpy()], axis=1)
    follows = (n > 0).reshape(256, 256, 2).sum(axis=0).astype(float)
    both = np.repeat((n.sum(axis=1) > 0).reshape(256, 256).sum(axis=0).astype(float)[:, None], 2, axis=1)
    one = np.zeros(256, np.int64)
    kept, freed = _shares(one, 1, both)
    shared = kept + freed[0] / 256
    kept, none = _shares(one, 1, follows)
    alone = kept + none[0] * shared
    last, byte = np.divmod(np.arange(1 << 16), 256)
    kept, freed = _shares(last, 256, n)
    p = kept + freed[last] * alone[byte]
    seen, used, known = n.sum(axis=1) > 0, n.reshape(256, -1).sum(axis=1) > 0, follows.sum(axis=1) > 0
    parts = ((last[seen], byte[seen], p[seen]), (np.arange(256)[used], np.zeros(used.sum(), int), freed[used]), (np.zeros(known.sum(), int), np.arange(256)[known], alone[known]), (np.zeros(1, int), np.zeros(1, int), none))
    return p, np.concatenate([keyed(c.astype(np.uint64), b) for c, b, _ in parts]), np.concatenate([_log_ratio(x) for _, _, x in parts])


def _long(short: np.ndarray):
    """Keys and ratios of the events of contexts of two bytes and more; those that end in the same two come together.

    Longest contexts, and those from a word's start, have counts; any other has the number of bytes seen before it.
    """

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [b for b in rows if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        context, byte = whole["context"].to_numpy().view(np.uint64), whole["byte"].to_numpy().astype(np.uint64)
        counts = np.stack([whole["c0"].to_numpy(), whole["c1"].to_numpy()], axis=1).astype(float)
        length = _lengths(context)
        levels = []  # from the longest: contexts, bytes, counts, and each event's place in the next level
        c, x, n = (a[length == DEPTH] for a in (context, byte, counts))
        for size in range(DEPTH, 2, -1):
            less, back = np.unique((c & _MASKS[size - 1]) << np.uint64(8) | x, return_inverse=True)
            levels.append((c, x, n, back))
            own = length == size - 1
            seen = np.stack([np.bincount(back, weights=n[:, k] > 0, minlength=len(less)) for k in (0, 1)], axis=1)
            c, x = np.concatenate([less >> np.uint64(8), context[own]]), np.concatenate([less & np.uint64(255), byte[own]])
            n = np.concatenate([seen, counts[own]])
        levels.append((c, x, n, ((c & np.uint64(255)) << np.uint64(8) | x).astype(np.int64)))
        p = short
        for c, x, n, back in reversed(levels):
            each, group = np.unique(c, return_inverse=True)
            kept, freed = _shares(group, len(each), n)
            p = kept + freed[group] * p[back]
            key, ratio = _entries(c, x, p, kept, each, freed)
            yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(key)), pa.array(ratio)], ["key", "ratio"])

    return run


def _model(events: DataFrame) -> Model:
    """From counts by context and byte; the table grows with the training rows' events and contexts."""
    n = events.count()
    pair = events.where("context & -256 <> 0").withColumn("pair", F.expr("context & 65535"))
    found = pair.groupBy("pair", "byte").agg(F.max(F.expr("int(c0 > 0)")).alias("n0"), F.max(F.expr("int(c1 > 0)")).alias("n1"))
    found = found.groupBy(F.expr("pair & 255").alias("last"), "byte").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = found.unionByName(events.where("context & -256 = 0").select(F.col("context").alias("last"), "byte", F.col("c0").alias("n0"), F.col("c1").alias("n1")))
    short, keys, ratio = _short(found.toArrow())
    if n > TABLE_EVENTS:
        model = Model(keys, ratio)
        model.events, model.short = events, short
        return model
    parts = max(events.sparkSession.sparkContext.defaultParallelism, -(-n // _EVENTS))
    rest = pair.repartition(parts, "pair").select("context", "byte", "c0", "c1").mapInArrow(_long(short), "key long, ratio float").toArrow()
    return Model(np.concatenate([keys, rest["key"].to_numpy().view(np.uint64)]), np.concatenate([ratio, rest["ratio"].to_numpy()]))


def _spelled(rows: Iterable[pa.RecordBatch], column: str = "text") -> Iterable[tuple[pa.RecordBatch, int, int, Spelled]]:
    for batch in rows:
        body, offsets = kernel.utf8(batch[column])
        for a, b in kernel.chunks(offsets):
            yield batch, a, b, Spelled(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@kernel.tidy
def _spellings(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Different words of texts."""
    for _, _, _, words in _spelled(rows):
        body = words.texts.body.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(words.id)), pa.array([body[a : a + n] for a, n in zip(words.start.tolist(), words.size.tolist(), strict=True)], pa.binary())], ["word", "spelling"])


@kernel.tidy
def _asked(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The events of words, by word and piece."""
    for batch in rows:
        for at in range(0, batch.num_rows, 10_000):
            spellings = batch["spelling"].slice(at, 10_000).to_pylist()
            words = Spelled(np.frombuffer(b"".join(spellings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spellings])]))
            piece = np.minimum(words.place // PIECE, np.repeat(words.pieces()[0] - 1, words.size + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kernel.signed(np.repeat(words.id, words.size + 1))), pa.array(piece.astype(np.int32)), pa.array(kernel.signed(words.context)), pa.array(words.byte.astype(np.int16))], ["word", "piece", "context", "byte"]
            )


def _answers(model: Model):
    """Ratios of the events asked for, summed by word and piece; a part's counted events come first."""

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, own = [], None
        for batch in rows:
            asked = batch["word"].is_valid()
            held.append(batch.filter(pc.invert(asked)).select(["context", "byte", "c0", "c1"]))
            batch = batch.filter(asked)
            if not batch.num_rows:
                continue
            if own is None:
                made = list(_long(model.short)(held))
                own = Model(np.concatenate([model.keys[:-1], *(x["key"].to_numpy().view(np.uint64) for x in made)]), np.concatenate([model.ratio[:-1], *(x["ratio"].to_numpy() for x in made)]))
            context = batch["context"].to_numpy().view(np.uint64)
            value = own.ratios(context, batch["byte"].to_numpy().astype(np.uint64), _lengths(context))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["piece"], pa.array(value)], ["word", "piece", "value"])

    return run


def _needed(name: str):
    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, a, b, words in _spelled(rows):
            part = np.asarray(batch[name])[a:b]
            key = np.unique(np.stack([part[words.texts.text_of()].astype(np.int64), words.number], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(kernel.signed(words.id[key[:, 1]]))], ["part", "word"])

    return run


def _place(word: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return kernel.mix(word + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)


def _apart(docs: DataFrame, model: Model, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``finish`` over batches of ``docs`` and their features, without a table of the model in any place.

    The distinct words of all texts are asked where the events are. Rows are dealt evenly over parts; each part gets the
    values of its words, and then its rows in a stream.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    words = table(texts.mapInArrow(_spellings, "word long, spelling binary").distinct())
    asked = words.mapInArrow(_asked, "word long, piece int, context long, byte short")
    events = model.events.where("context & -256 <> 0")
    none = F.lit(None)
    both = events.select(none.cast("long").alias("word"), none.cast("int").alias("piece"), "context", "byte", "c0", "c1").unionByName(asked, allowMissingColumns=True)
    laid = both.repartition(max(parts, -(-events.count() // _EVENTS)), F.expr("context & 65535")).sortWithinPartitions(F.col("word").isNotNull())
    values = table(laid.mapInArrow(_answers(model), "word long, piece int, value double").groupBy("word", "piece").agg(F.sum("value").alias("value")))
    release(words)
    sweep(spark)
    name = free(docs, "_part")
    plain = [c for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")]
    dealt = docs.withColumn(name, F.pmod(F.xxhash64(*plain), F.lit(parts)))
    need = dealt.select(F.coalesce("text", F.lit("")).alias("text"), name).mapInArrow(_needed(name), "part long, word long").distinct().join(values, "word")
    own = [free(docs, x) for x in ("_word", "_piece", "_value")]
    need = need.select(F.col("part").alias(name), *(F.col(x[1:].rstrip("_")).alias(x) for x in own))
    rows = dealt.unionByName(need, allowMissingColumns=True).repartitionById(parts, F.col(name).cast("int")).sortWithinPartitions(F.col(own[0]).isNull())
    columns = docs.columns

    @kernel.tidy
    def run(found: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, key, value = [], None, None
        for batch in found:
            given = batch[own[0]].is_valid()
            held.append(batch.filter(given).select(own))
            batch = batch.filter(pc.invert(given)).select(columns)
            if not batch.num_rows:
                continue
            if key is None:
                word, piece, value = (np.concatenate([np.asarray(x[c]) for x in held]) for c in own)
                key = _place(word.astype(np.int64).view(np.uint64), piece)
                order = np.argsort(key)
                key, value, held = key[order], value[order].astype(float), []

            def valued(words: Spelled) -> np.ndarray:
                many, head = words.pieces()
                asked = _place(np.repeat(words.id, many), words.place[head] // PIECE)
                return value[np.searchsorted(key, asked)] if len(asked) else np.zeros(0)

            body, offsets = kernel.utf8(batch["text"])
            for a, b in kernel.chunks(offsets):
                yield finish(batch.slice(a, b - a), model.features(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], valued))

    return rows.mapInArrow(run, schema)


def fold(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string")) % 5


def _by_table(docs: DataFrame, model: Model | None, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``finish`` over batches of ``docs`` and their features, with the model's table sent to the executors."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            body, offsets = kernel.utf8(batch["text"])
            for a, b in kernel.chunks(offsets):
                found = np.zeros((b - a, 0)) if sent.value is None else sent.value.features(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield finish(batch.slice(a, b - a), found)

    return docs.mapInArrow(run, schema)


def _featured(docs: DataFrame, model: Model | None, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    return (_by_table if model is None or model.events is None else _apart)(docs, model, finish, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0 or 1) marks; None if a class is missing.

    crc32 of the doc_id modulo 5: rows of 0 are never used; 1 to 3 are counted; 4 fits the score's curve. Several
    labels of one doc_id count as toxic if one does. Null texts and labels are left out.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0)
    marks = table(marks)
    maybe, _ = split_by(docs.where("text is not null and doc_id is not null").select("doc_id", "text"), marks, "doc_id", marks.count())
    known = table(maybe.join(marks, "doc_id").select("doc_id", "text", "toxic"))
    n = known.where(fold() == 4).count()
    curve = (fold() == 4) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_ROWS / max(n, 1))))
    rows = known.where(curve)
    events = table(known.where(~curve).select("text", "toxic").mapInArrow(_events, "context long, byte short, c0 long, c1 long").groupBy("context", "byte").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    model = _model(events)
    listed = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    found = _featured(rows.select("text", "toxic"), model, lambda batch, x: pa.RecordBatch.from_arrays([batch["toxic"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "features"]), listed).toArrow()
    release(marks, known, *([events] if model.events is None else []))
    sweep(spark)
    y = found["toxic"].to_numpy().astype(float) if found.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array(found["features"].to_pylist())
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = logistic((x - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text and any others) with score (0 to 1) and predicted (1 where score is 0.5 or more).

    Null and empty texts have neutral features. Without a model every score is 0. Only the text is read; columns named
    like the operator's own are replaced.
    """
    docs = docs.drop("score", "predicted")
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    curve = None if model is None else (model.mean, model.scale, model.weights)

    def finish(batch: pa.RecordBatch, features: np.ndarray) -> pa.RecordBatch:
        found = np.zeros(batch.num_rows) if curve is None else curved(features, *curve)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return _featured(docs, model, finish, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
