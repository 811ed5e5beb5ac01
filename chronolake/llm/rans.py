"""Token-id files coded with a static range asymmetric numeral system.

One frequency table, counted over every document, serves all blocks. A block
holds whole documents of ascending doc_id: its ids are dealt over ``LANES``
interleaved states, coded backwards row by row, with the lane states and the
place in the words written down every ``CHECK_ROWS`` rows, so a reader may begin
at any checkpoint. Headers carry checksums of the ids and of the coded body.

Layout of a block (little endian): magic, then a header of seven 32-bit numbers
(version, lanes, ids, rows between checkpoints, number of words, crc32 of the ids
as 32-bit numbers, crc32 of all that follows the header); one (word place u32, states u64 x lanes)
for each checkpoint, the first being the start; the words as u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from ._tokens import encoder
from ._work import RANGED, folder, into_ranges, range_cuts

MAGIC, VERSION = b"CLRN", 1
SCALE = 20
LANES, CHECK_ROWS = 2048, 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s7I")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE, each id at least 1."""
    m = 1 << SCALE
    if len(counts) > m // 2:
        raise ValueError(f"a vocabulary of {len(counts)} ids needs a larger SCALE")
    total = max(1, int(counts.sum()))
    f = np.maximum(1, counts.astype(np.int64) * (m - len(counts)) // total)
    f[int(np.argmax(f))] += m - int(f.sum())
    return f.astype(np.uint64)


class Coder:
    """Codes and decodes blocks under one table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = min(LANES, max(1, n))
        rows = -(-n // lanes)
        grid = np.zeros(rows * lanes, np.int64)
        grid[:n] = ids
        grid = grid.reshape(rows, lanes)
        x = np.full(lanes, _LOW)
        out, marks, k, low32 = [], [], np.uint64(SCALE), np.uint64(0xFFFFFFFF)
        written = 0
        for t in range(rows - 1, -1, -1):
            s = grid[t]
            f, c = self.freq[s], self.start[s]
            full = x >= (f << np.uint64(63 - SCALE))
            if full.any():
                w = (x[full] & low32).astype(np.uint32)
                x[full] >>= np.uint64(32)
                out.append(w)
                written += len(w)
            q = x // f
            x = (q << k) + (x - q * f) + c
            if t % CHECK_ROWS == 0:
                marks.append((written, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        raw = words.astype("<u4").tobytes()
        body = b"".join(struct.pack("<I", len(words) - at) + s.astype("<u8").tobytes() for at, s in reversed(marks)) + raw
        return _HEAD.pack(MAGIC, VERSION, lanes, n, CHECK_ROWS, len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, block: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, checked; or those from checkpoint ``part`` to the next."""
        magic, version, lanes, n, every, n_words, ids_crc, body_crc = _HEAD.unpack_from(block)
        if magic != MAGIC or version != VERSION:
            raise ValueError("this is no block of token ids")
        rows = -(-n // lanes)
        parts = -(-rows // every)
        one = 4 + 8 * lanes
        body = memoryview(block)[_HEAD.size :]
        raw = body[parts * one :]
        if len(raw) != 4 * n_words or zlib.crc32(body) != body_crc:
            raise ValueError("the block's checkpoints and words fail their checksum")
        words = np.frombuffer(raw, "<u4")
        first, last = (0, rows) if part is None else (part * every, min(rows, (part + 1) * every))
        if rows == 0:
            return np.zeros(0, np.uint32)
        base = _HEAD.size + (first // every) * one
        at = struct.unpack_from("<I", block, base)[0]
        x = np.frombuffer(block, "<u8", lanes, base + 4).astype(np.uint64)
        out = np.empty((last - first, lanes), np.uint32)
        mask, k = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for t in range(last - first):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[t] = s
            x = self.freq[s] * (x >> k) + slot - self.start[s]
            need = np.flatnonzero(x < _LOW)
            if len(need):
                x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)]
                at += len(need)
        ids = out.reshape(-1)[: n - first * lanes]
        if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("the block's ids fail their checksum")
        return ids


def _count(path):
    def f(batches):
        import pyarrow as pa

        e, total, key = encoder(path), None, 0
        for b in batches:
            if total is None:
                total = np.zeros(e.size, np.int64)
            data, off = T.buffers(b.column("text"))
            key = (key + len(data)) % 16
            for i, j in T.chunks(off):
                d = data[off[i] : off[j]]
                if len(d):
                    ids, _ = e.encode(d, off[i : j + 1] - off[i])
                    total += np.bincount(ids, minlength=e.size)
            total[0] += b.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["key", "counts"])

    return f


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})


def _encode(path, freq, block_ids):
    def f(table: pa.Table) -> pa.Table:
        e, coder = encoder(path), Coder(freq)
        rng = table.column("rng")[0].as_py()
        table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        data, off = T.buffers(table.column("text"))
        doc, parts, counts = table.column("doc_id").combine_chunks(), [], []
        for i, j in T.chunks(off):
            ids, first = e.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append(np.insert(ids, first[1:], 0))
            counts.append(np.diff(first) + 1)
        ids, n = np.concatenate(parts), np.concatenate(counts)
        ends = np.cumsum(n)
        rows, i = [], 0
        while i < len(n):
            at = int(ends[i] - n[i])
            j = max(i + 1, int(np.searchsorted(ends, at + block_ids, "right")))
            d = doc.slice(i, j - i)
            rows.append((rng, len(rows), at, d.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), d.is_null().to_numpy(zero_copy_only=False).tobytes(), n[i:j].astype("<i8").tobytes(), int(ends[j - 1]) - at, coder.encode(ids[at : int(ends[j - 1])])))
            i = j
        return pa.table(list(map(list, zip(*rows))), schema=_schema())

    return f


_BLOCK = "rng long, block int, offset long, doc_ids binary, doc_null binary, doc_sizes binary, n_ids long, payload binary"


def _schema():
    t = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], t[x.split()[1]]) for x in _BLOCK.split(", ")])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, range_bytes: int = 4 << 20, block_ids: int = 1 << 19) -> None:
    """Write the ids of every text, each followed by id 0, in ascending doc_id order, below ``path``.

    ``path``/table holds the frequency table, ``path``/blocks the blocks. A null
    text is empty; null doc_ids come first; rows of one doc_id go by text. A range
    of documents (``range_bytes`` of text) is coded by one task.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = docs.select("text").mapInArrow(_count(vocabulary), "key long, counts binary").groupBy("key").applyInArrow(_sum, "counts binary").collect()
    counts = sum((np.frombuffer(r.counts, np.int64) for r in sums), np.zeros(1, np.int64))
    freq = frequencies(counts)
    spark.createDataFrame([(VERSION, SCALE, bytearray(freq.astype("<u4").tobytes()))], "version int, scale int, freq binary").write.parquet(f"{path}/table")
    cuts, _ = range_cuts(docs, range_bytes)
    docs.mapInArrow(into_ranges(cuts), RANGED).groupBy("rng").applyInArrow(_encode(vocabulary, freq, block_ids), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def _read(freq, starts, with_ids):
    def f(batches):
        coder = Coder(freq)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode(r["payload"]).astype("<u4")
                doc, n = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_sizes"], "<i8")
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (z - k) : 4 * z]) for z, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array(doc, mask=np.frombuffer(r["doc_null"], bool)), pa.array(starts[r["rng"]] + r["offset"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return f


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    ship(spark)
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first()["freq"], "<u4")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    sizes = {r.rng: r.n for r in blocks.groupBy("rng").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each range
    starts, at = {}, 0
    for k in sorted(sizes):
        starts[k], at = at, at + sizes[k]
    return blocks.mapInArrow(_read(freq, starts, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op6_token_files(spark, sf_dir) -> DataFrame:
    import uuid

    import public_tokenizers

    at = f"{folder(spark)}/op6-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), at, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, at)
