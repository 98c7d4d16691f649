"""Quality rules from repetition: suffix arrays over the words of each text.

Method: a suffix array of many texts' words is built by prefix doubling; ranks start with the text's number, so suffixes
of different texts never compare equal. Longest common prefixes of neighbours in it come from the ranks kept of every
doubling. A text's maximal repeated substrings are the spans of those prefixes; their union over spans of at least
``least_words`` words gives the covered fraction, the largest one the longest repeat. Both are limited.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import kernel

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Words of a repeated substring for it to count, and the limits of the verdict.
LEAST_WORDS, MOST_COVERED, LONGEST_WORDS, LONGEST_SHARE = 8, 0.25, 50, 0.15


def repeats(texts: kernel.Words) -> np.ndarray:
    """For each word the length, in words, of the longest run from it that also starts elsewhere in its text."""
    n = len(texts.start)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    last = np.repeat(texts.bounds[1:], texts.count)
    _, code = np.unique(texts.ids(), return_inverse=True)
    key = texts.text_of().astype(np.int64) * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    small = np.int32 if n < 1 << 31 else np.int64  # ranks of every doubling are held
    rank = np.empty(n, small)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    del key, code, new
    levels, width = [rank], 1
    at = np.arange(n)  # slots of the suffix array that are not settled
    while True:
        own = order[at]
        group = rank[own]
        # groups of one are settled
        alone = np.concatenate([[True], group[1:] != group[:-1]]) & np.concatenate([group[1:] != group[:-1], [True]])
        at, own, group = at[~alone], own[~alone], group[~alone]
        if not len(at):
            break
        ahead = own + width
        inside = ahead < last[own]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        by = np.argsort(group.astype(np.int64) * (n + 1) + second, kind="stable")
        own, group, second = own[by], group[by], second[by]
        order[at] = own
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank)
        width *= 2
    # common prefixes of neighbours: equal ranks of the doubling k mean 2**k equal words
    p, q = order[:-1].copy(), order[1:].copy()
    same = levels[0][p] == levels[0][q]
    p, q, slot = p[same], q[same], np.flatnonzero(same)
    length = np.zeros(len(p), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = p + length, q + length
        ok = (x < last[p]) & (y < last[q])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        length[ok] += 1 << k
    np.maximum.at(longest, order[slot], length)
    np.maximum.at(longest, order[slot + 1], length)
    return longest


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def _line_repeats(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(body)
    newline = np.flatnonzero(body == 10)
    start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    start = start[start < n]
    end = np.concatenate([start[1:], [n]]) if len(start) else start
    end = end - ((body[end - 1] == 10) if len(start) else 0)
    text = np.searchsorted(offsets, start, "right") - 1
    up, down = kernel.powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    words = np.concatenate([[0], np.cumsum(~kernel._SEP[body])])
    full = words[end] > words[start]
    start, end, text = start[full], end[full], text[full]
    line = kernel.mix((run[end] - run[start]) * down[start]) ^ kernel.mix((end - start).astype(np.uint64), 10)
    order = np.lexsort((line, text))
    again = (line[order][1:] == line[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][again], minlength=len(offsets) - 1)


def measures(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    texts = kernel.Words(body, offsets)
    n = len(texts.start)
    inside = np.zeros(len(body) + 1, np.int8)
    np.add.at(inside, texts.start, 1)
    np.add.at(inside, texts.end, -1)
    word = np.cumsum(inside[:-1]) > 0
    longest = repeats(texts)
    thrice = np.flatnonzero(longest >= 3)
    long = np.flatnonzero(longest >= LEAST_WORDS)
    top = np.zeros(len(texts.count), np.int64)
    np.maximum.at(top, texts.text_of(), longest)
    out = {
        "n_words": texts.count,
        "word_chars": _per_text(word & ((body & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[body], offsets),
        "n_dup_lines": _line_repeats(body, offsets),
        "n_repeat_words": _per_text(covered(thrice, np.full(len(thrice), 3), n), texts.bounds),
        "n_covered": _per_text(covered(long, longest[long], n), texts.bounds),
        "longest_repeat": top,
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rules fail, and whether the text is kept."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    good = (m["n_covered"] <= MOST_COVERED * m["n_words"]) & (m["longest_repeat"] <= np.maximum(LONGEST_WORDS, LONGEST_SHARE * m["n_words"]))
    return failed, good & ~failed


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any others) with its measures of repetition, ``base_failed`` and ``kept``.

    Null and empty texts have no words: base_failed, not kept. Each row is judged alone, whatever its other columns
    hold; columns named like the operator's own are replaced. Memory follows the longest single text: about 4 bytes a word
    for each doubling of its longest repeat, and some 100 bytes a word besides.
    """
    docs = docs.drop(*_COLUMNS, "base_failed", "kept")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    @kernel.tidy
    def run(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in rows:
            body, offsets = kernel.utf8(batch["text"])
            for a, b in kernel.chunks(offsets):
                m = measures(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                failed, kept = verdict(m)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(m[c]) for c in _COLUMNS), pa.array(failed), pa.array(kept)], [*own.schema.names, *_COLUMNS, "base_failed", "kept"])

    fields = [*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in _COLUMNS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(fields))
