"""Token ids of a byte-level BPE vocabulary, by its own tokenizer but with each different piece of text encoded once.

Texts are cut where the vocabulary's pre-tokenizer cuts them (contractions, letters, numbers, other marks, each with the
space before them; white space), in NumPy over code points. Different pieces are found by hash, and only those that a
bounded cache doesn't know go to the tokenizer. Texts with characters whose class may differ between Unicode versions,
or with an added token's content, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from tidemark.llm import kernel

_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)
_MOST_CACHED = 800_000


def _alphabet() -> dict[int, int]:
    """The characters by which a byte-level vocabulary spells bytes: printable ones as they are, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_SPELLED = _alphabet()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, _UNSURE, np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        out[c] = _UNSURE if kind in ("Cn", "Cs") else _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = _SPACE
    return out


def pieces(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts whose code points lie one after another, in order."""
    n = len(codes)
    kind = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text begins here
    change = np.ones(n + 1, bool)
    change[1:n] = (kind[1:] != kind[:-1]) | first[1:n]
    space = kind == _SPACE
    plain = np.zeros(n, bool)
    plain[1:] = (codes[:-1] == 32) & ~first[1:n]  # the character before, of this text, is a space
    cut = change[:n] & (space | ~plain)
    # the last of several white space characters before something else starts a piece
    cut |= space & change[1:] & ~first[1:]
    quote = np.flatnonzero((codes == 39) & change[:n] & change[1:] & ~plain & ~first[1:])
    quote = quote[kind[np.minimum(quote + 1, n - 1)] == _LETTER]
    if len(quote):
        a = codes[quote + 1]
        more = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        b = np.where(more, codes[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        at, size = quote[one | two], np.where(one, 1, 2)[one | two]
        cut[at + 1] = False
        after = at + 1 + size
        inside = (after < n) & ~first[np.minimum(after, n)]
        cut[after[inside]] |= kind[after[inside]] == _LETTER
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        model = self.tokenizer.model
        ids = [[t.id for t in model.tokenize(x.encode().decode("latin-1").translate(_SPELLED))] for x in texts]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.at, self.size = every[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their offsets by text."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        odd = np.add.reduceat(np.concatenate([_classes()[codes] == _UNSURE, [False]]).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) > 0
        for content in self.added:
            if content in joined:
                odd |= np.array([content in t for t in texts])
        start = pieces(codes, offsets)
        end = np.concatenate([start[1:], [len(codes)]])
        up, down = kernel.powers(len(codes) + 1)
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        key = kernel.mix((run[end] - run[start]) * down[start])
        distinct, first, number = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > _MOST_CACHED:
            self.forget()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            at = first[new]
            self._learn(distinct[new], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place = np.searchsorted(self.keys, distinct)
        size = self.size[place][number]
        until = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[place][number] - (until - size), size) + np.arange(until[-1])]
        bounds = np.concatenate([[0], until])[np.searchsorted(start, offsets)]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            at = np.flatnonzero(odd)
            for i, own in zip(at.tolist(), self.whole([texts[i] for i in at]), strict=True):
                parts[i] = np.array(own, np.int32)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            ids = np.concatenate(parts)
        return ids, bounds


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
