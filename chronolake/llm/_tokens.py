"""Token ids of whole Arrow batches through the tokenizers library.

A text is cut before each single space or newline that stands between two
characters that are no white space. Both public vocabularies split there before
any merge, so a text's ids are its segments' ids in order. Each distinct segment
is encoded once in a worker and found again by its hash in an open-addressing
table, which a batch probes with numpy.
"""

from __future__ import annotations

import os

import numpy as np

from . import _text as T

_MOST_SLOTS = 1 << 23


class Encoder:
    """Encodes batches as the library does by default; keeps the ids of the segments seen so far. No special token holds white space, so none crosses a segment."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one worker, one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.reset(1 << 18)

    def reset(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.slot = np.zeros(slots, np.int32)
        self.used = 0
        self.begin = np.zeros(slots // 2 + 1, np.int64)
        self.count = np.zeros(slots // 2 + 1, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32 if self.size > 65536 else np.uint16)
        self.filled = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's entry, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        k = self.keys[at]
        out = np.where(k == h, self.slot[at], -1)
        todo = np.flatnonzero((k != h) & (k != 0))
        while len(todo):
            p = (at[todo] + 1) & int(mask)
            at[todo] = p
            k = self.keys[p]
            hit = k == h[todo]
            out[todo[hit]] = self.slot[p[hit]]
            todo = todo[~hit & (k != 0)]
        return out

    def place(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, one = np.unique(at[free], return_index=True)
            win = free[one]
            self.keys[at[win]] = h[win]
            self.slot[at[win]] = entry[win]
            lost = np.ones(len(h), bool)
            lost[win] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & mask

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Encode new segments and keep them."""
        slots = len(self.keys)
        if (self.used + len(h)) * 2 > slots:
            live = self.keys != 0
            keys, entry = self.keys[live], self.slot[live]
            while (self.used + len(h)) * 2 > slots:
                slots *= 2
            if slots > _MOST_SLOTS and self.used:
                self.reset(1 << 18)
                return self.learn(h, words)
            self.keys, self.slot = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self.begin = np.resize(self.begin, slots // 2 + 1)
            self.count = np.resize(self.count, slots // 2 + 1)
            self.place(keys, entry)
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + total] = np.fromiter((i for x in ids for i in x), self.pool.dtype, total)
        entry = np.arange(self.used, self.used + len(h))
        self.begin[entry] = self.filled + np.cumsum(n) - n
        self.count[entry] = n
        self.filled += total
        self.used += len(h)
        self.place(h, entry)

    def entries(self, data: np.ndarray, off: np.ndarray):
        """(entry of every segment, each text's first segment) of a chunk of texts; all are learnt on return."""
        starts, first = segments(data, off)
        ends = np.append(starts[1:], len(data))
        h = T.span_hashes(data, starts, ends)
        h[h == 0] = 1
        e = self.find(h)
        if (e < 0).any():
            miss = np.flatnonzero(e < 0)
            _, one = np.unique(h[miss], return_index=True)
            one = miss[one]
            raw = data.tobytes()
            before = self.used
            self.learn(h[one], [raw[starts[i] : ends[i]].decode() for i in one])
            if self.used <= before:  # the table was emptied for room
                e = self.find(h)
                if (e < 0).any():
                    return self.entries(data, off)
            e[miss] = self.find(h[miss])
        return e, first

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each text's first id; one more entry at the end)."""
        if len(data) == 0:
            return self.pool[:0], np.zeros(len(off), np.int64)
        e, first = self.entries(data, off)
        n = self.count[e].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(self.begin[e] - (ends - n), n)
        return self.pool[at], np.concatenate([[0], ends])[first]


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every segment, each text's first segment). Segments cover every byte."""
    gap = (data == 32) | (data == 10)
    white = T.SPACES[data]
    p = np.flatnonzero(gap)
    p = p[(p > 0) & (p < len(data) - 1)]
    p = p[~white[p - 1] & ~white[p + 1]]
    follow, prior = data[p + 1], data[p - 1]
    bad = (follow == 0xC2) | ((follow >= 0xE1) & (follow <= 0xE3))
    high = np.flatnonzero(prior >= 0x80)
    q = p[high]
    lead2, lead3 = data[q - 2], data[np.maximum(q - 3, 0)]
    bad[high] |= (lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3))
    begin = np.zeros(len(data), bool)
    begin[p[~bad]] = True
    begin[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, off)


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def forget() -> None:
    """Free this worker's encoders: workers outlive a stage, and the tables of one stage need not lie beside the work of another."""
    _KEPT.clear()
