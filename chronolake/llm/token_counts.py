"""Token counts by a two-tier lookup of pre-tokens inside the map tasks; no pre-token is shuffled.

A text is cut before each run of spaces and of newlines. No piece of the
vocabulary has a space after another character or holds a newline (checked when
the model is loaded), so no merge crosses a cut and a text's count is the sum of
its pre-tokens' counts.

Tier one is one hash table of the lengths of frequent pre-tokens, broadcast once.
It is filled from the first ``SAMPLE_BYTES`` of text in each of at most
``SAMPLE_TASKS`` input partitions and holds at most ``FREQUENT`` entries, so its
size is fixed whatever the input. It only saves work: counts do not depend on it.
Tier two is each worker's own table of the pre-tokens that tier one lacks, kept
between batches and emptied at ``_tokens._MOST_SLOTS``. Pre-tokens over
``LONG`` bytes are encoded each time and kept nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from . import _tokens

LIMIT = 4096
FREQUENT = 1 << 15  # entries of tier one
SAMPLE_TASKS, SAMPLE_BYTES, SAMPLE_EACH = 32, 1 << 20, 1 << 13  # partitions, bytes and pre-tokens from each that fill tier one
LONG = 64
_FIRST = np.uint64(0xA5A5_5A5A_1234_4321)  # tells the first pre-token of a text, which gets a leading space, from others


class Lengths(_tokens.Encoder):
    """Counts of pre-tokens by hash, in the open-addressing table of the encoder."""

    def __init__(self, slots: int = 1 << 16):
        self.reset(slots)

    @classmethod
    def of(cls, h: np.ndarray, counts: np.ndarray) -> Lengths:
        out = cls(1 << max(4, int(2 * len(h)).bit_length()))
        out.place(h, counts.astype(np.int32))
        return out

    def reset(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.slot = np.zeros(slots, np.int32)
        self.used = 0

    def learn(self, h: np.ndarray, counts: np.ndarray) -> None:
        slots = len(self.keys)
        while (self.used + len(h)) * 2 > slots:
            slots *= 2
        if slots > len(self.keys):
            live = self.keys != 0
            keys, entry, used = self.keys[live], self.slot[live], self.used
            if slots > _tokens._MOST_SLOTS and used:
                self.reset(1 << 16)
                return self.learn(h, counts)
            self.reset(slots)
            self.place(keys, entry)
            self.used = used
        self.place(h, counts)
        self.used += len(h)


class Pieces:
    """One worker's model and second tier."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        words = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in w or "▁" in w.lstrip("▁") for w in words) or len(self.model.encode("a")) != 1 or self.model.encode("a b")[:1] != self.model.encode("a"):
            raise ValueError("pre-tokens of this model cannot be cut at spaces and newlines")
        self.seen = Lengths()

    def encoded(self, words: list[str]) -> np.ndarray:
        """Tokens of pre-tokens that follow another one: those of "a" and the pre-token, less the one of "a"."""
        got = self.model.encode(["a" + w for w in words], num_threads=1)
        return np.fromiter(map(len, got), np.int64, len(got)) - 1

    def counts(self, data: np.ndarray, off: np.ndarray, tier: Lengths):
        """(tokens of every pre-token, its hash, each text's first pre-token)."""
        starts, first = pretokens(data, off)
        ends = np.append(starts[1:], len(data))
        h = T.span_hashes(data, starts, ends)
        heads = first[:-1][np.diff(first) > 0]
        h[heads] ^= _FIRST
        h[h == 0] = 1
        n = tier.find(h).astype(np.int64)
        miss = np.flatnonzero(n < 0)
        if len(miss):
            n[miss] = self.seen.find(h[miss])
            miss = miss[n[miss] < 0]
        if len(miss):
            raw = data.tobytes()
            lead = np.zeros(len(starts), bool)
            lead[heads] = True
            word = lambda i: (" " if lead[i] else "") + raw[starts[i] : ends[i]].decode()
            long = ends[miss] - starts[miss] > LONG
            for i in miss[long]:
                n[i] = self.encoded([word(i)])[0]
            miss = miss[~long]
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = self.encoded([word(i) for i in miss[one]])
            n[miss] = got[back]
            self.seen.learn(h[miss[one]], got.astype(np.int32))
        return n, h, first


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every pre-token, each text's first pre-token); they cover every byte. The model's own sign for a space, which ends in byte 0x81, counts as a space."""
    begin = np.zeros(len(data), bool)
    prior, own = data[:-1], data[1:]
    begin[1:] = ((own == 32) & (prior != 32) & (prior != 0x81)) | ((own == 10) & (prior != 10))
    begin[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, off)


_KEPT: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def _sampled(path: str, every: int):
    """One row for each ``every``-th partition: its most frequent pre-tokens, their counts in the sample and their lengths. Other partitions are not read."""

    def f(batches):
        if TaskContext.get().partitionId() % every:
            return
        p, none, hs, ns, left = pieces(path), Lengths(16), [], [], SAMPLE_BYTES
        for b in batches:
            data, off = T.buffers(b.column(0))
            for i, j in T.chunks(off, 1 << 18):
                n, h, _ = p.counts(data[off[i] : off[j]], off[i : j + 1] - off[i], none)
                hs.append(h)
                ns.append(n)
                left -= int(off[j] - off[i])
                if left <= 0:
                    break
            if left <= 0:
                break
        if hs:
            h, one, count = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            top = np.argsort(-count, kind="stable")[:SAMPLE_EACH]
            n = np.concatenate(ns)[one][top].astype(np.int32)
            yield pa.RecordBatch.from_pydict({"h": pa.array([h[top].tobytes()]), "seen": pa.array([count[top].astype(np.int64).tobytes()]), "n": pa.array([n.tobytes()])})

    return f


def frequent(texts: DataFrame, path: str, most: int = FREQUENT) -> Lengths:
    """Tier one. At most SAMPLE_TASKS rows of SAMPLE_EACH entries reach the driver."""
    every = max(1, -(-texts.rdd.getNumPartitions() // SAMPLE_TASKS))
    rows = texts.mapInArrow(_sampled(path, every), "h binary, seen binary, n binary").collect()
    if not rows:
        return Lengths(16)
    h, seen, n = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in enumerate((np.uint64, np.int64, np.int32)))
    keys, one, back = np.unique(h, return_index=True, return_inverse=True)
    top = np.argsort(-np.bincount(back, seen), kind="stable")[:most]
    return Lengths.of(keys[top], n[one][top])


def _counted(path: str, tier):
    def f(batches):
        p = pieces(path)
        for b in batches:
            data, off = T.buffers(b.column("text"))
            total = np.zeros(len(off) - 1, np.int64)
            for i, j in T.chunks(off):
                if off[j] > off[i]:
                    n, _, first = p.counts(data[off[i] : off[j]], off[i : j + 1] - off[i], tier.value)
                    ends = np.concatenate([[0], np.cumsum(n)])
                    total[i:j] = ends[first[1:]] - ends[first[:-1]]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_tokens": pa.array(total)})

    return f


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Counts are those of the sentencepiece model at ``path`` on the whole text,
    without begin or end tokens. A null text is empty and has no token. Repeated
    rows and null doc_ids are counted row by row; extra columns are ignored; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs.select("text"), path))
    out = docs.mapInArrow(_counted(path, tier), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
