"""Vectorised text kernels: words, word hashes and token ids of whole Arrow batches.

Texts are read straight from Arrow's buffers. A word's hash is multilinear over
its bytes (one random odd multiplier per place) and then mixed, so a batch costs
a few passes over its bytes and no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SEED = 0x5EED_2024


def _table(n: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)


_PLACES = _table(1 << 10)


def places(n: int) -> np.ndarray:
    """The first n place multipliers; the same prefix whatever n is."""
    global _PLACES
    if n > len(_PLACES):
        _PLACES = _table(1 << int(n).bit_length())
    return _PLACES[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> U(32))
    h = h * U(0x9E3779B97F4A7C15)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def separators(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SPACES = separators(b" \t\n\x0b\x0c\r")
#: White space and ASCII punctuation: all ASCII but letters and digits.
PUNCT = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: (starts, ends) in bytes, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~sep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span (spans ascend and do not overlap)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    b = data[place + np.repeat(starts, lens)].astype(np.uint64) + U(1)
    b *= places(int(lens.max()))[place]
    return mix(np.add.reduceat(b, at) + lens.astype(np.uint64))


def chunks(off: np.ndarray, most: int = 1 << 20):
    """Ranges [i, j) of texts of about ``most`` bytes, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(col, sep: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word) of a whole column, worked in small chunks."""
    data, off = buffers(col)
    hs, firsts, base = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(off):
        d = data[off[i] : off[j]]
        if lower:
            d = LOWER[d]
        s, e, f = spans(d, off[i : j + 1] - off[i], sep)
        hs.append(span_hashes(d, s, e))
        firsts.append(f[1:] + base)
        base += len(s)
    return (np.concatenate(hs) if hs else np.zeros(0, np.uint64)), np.concatenate(firsts)


def windows(h: np.ndarray, first: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of each run of ``width`` words inside one text: (hash at every start, whether the run fits)."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    fits = np.zeros(n, bool)
    if n >= width:
        m = n - width + 1
        acc = np.zeros(m, np.uint64)
        for k in range(width):
            acc *= U(base)
            acc += h[k : k + m]
        out[:m] = mix(acc)
        end = np.repeat(first[1:], np.diff(first))
        fits[:m] = np.arange(width, n + 1) <= end[:m]
    return out, fits
