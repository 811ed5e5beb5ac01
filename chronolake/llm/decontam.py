"""Benchmark decontamination by templates.

Words become template tokens: numbers, names (capitalised inside a sentence) and
units after a number turn into typed placeholders, other words stay, in lower
case. Windows of template tokens of the documents that pass a Bloom filter of the
benchmark's windows (a fixed number of bits, whatever the benchmark's size) are
hash-joined with them. Matches of one document and item at one shift are an
occurrence; it counts if its slots are consistent: each value in the item's slots
stands for one value in the document. Windows mostly of slots say little as templates;
an item's windows of that kind are hashed with their words and match exact copies only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T

WIDTH, NEED, CONSISTENT, LEAST = 8, 6, 0.9, 4
_BASE2 = 0xD1342543DE82EF95
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x9D1C_0001, 0x9D1C_0002, 0x9D1C_0003))
# Unit words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons "
    "ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "hz khz mhz ghz b kb mb gb tb w kw mw kwh v a ma n kn pa kpa j kj cal kcal k c f mph kmh usd eur gbp dollar dollars euro euros cent cents percent degree degrees"
).split()


def _unit_hashes():
    h, _ = T.word_hashes(pa.array(UNITS), T.PUNCT)
    return np.sort(h)


def template(col):
    """(template token hash, word hash, whether a slot, index of each text's first word) of a column of texts."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    low = pc.utf8_lower(col)
    data, off = T.buffers(col)
    ldata, loff = T.buffers(low)
    units = _unit_hashes()
    hs, ts, slots, firsts, base = [], [], [], [np.zeros(1, np.int64)], 0
    for i, j in T.chunks(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, _, f = T.spans(d, o, T.PUNCT)
        e, lo = ldata[loff[i] : loff[j]], loff[i : j + 1] - loff[i]
        a, z, _ = T.spans(e, lo, T.PUNCT)
        h = T.span_hashes(e, a, z)
        if len(s):
            c = d[s]
            number = (c >= 48) & (c <= 57)
            ahead = [d[np.minimum(s + k, len(d) - 1)] for k in range(4)]
            small = lambda x, y: ((x >= 97) & (x <= 122)) | ((x == 0xC3) & (y >= 0x9F))
            plain = (c >= 65) & (c <= 90) & small(ahead[1], ahead[2])
            accented = (c == 0xC3) & (ahead[1] >= 0x80) & (ahead[1] <= 0x9E) & small(ahead[2], ahead[3])
            capital = plain | accented  # a word all in capitals is no name
            one, two = d[np.maximum(s - 1, 0)], d[np.maximum(s - 2, 0)]
            stop = np.isin(two, np.frombuffer(b".!?:;\n", np.uint8)) | np.isin(one, np.frombuffer(b"\n\"'(.!?", np.uint8))
            stop |= np.isin(s, o) | np.isin(s - 1, o)
            name = capital & ~stop
            unit = np.zeros(len(s), bool)
            unit[1:] = number[:-1]
            unit &= ~number & (units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h)
            t = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
            slot = number | unit | name
        else:
            t, slot = h, np.zeros(0, bool)
        hs.append(h)
        ts.append(t)
        slots.append(slot)
        firsts.append(f[1:] + base)
        base += len(s)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(ts, np.uint64), join(hs, np.uint64), join(slots, bool), np.concatenate(firsts)


def _windows(t, slot, first, width):
    """(starts, first hash, second hash) of the windows of which at least half the tokens are literal."""
    w, fits = T.windows(t, first, width)
    w2, _ = T.windows(t, first, width, _BASE2)
    c = np.concatenate([[0], np.cumsum(slot)])
    at = np.flatnonzero(fits)
    at = at[2 * (c[at + width] - c[at]) <= width]
    salt = np.uint64(width)
    return at, T.mix(w[at] + salt), w2[at]


def _exact_windows(words, first, width, slot=None):
    """The same by word hashes, of all windows or, given slots, of those with mostly slots; their hashes differ from those of templates."""
    w, fits = T.windows(words, first, width)
    w2, _ = T.windows(words, first, width, _BASE2)
    at = np.flatnonzero(fits)
    if slot is not None:
        c = np.concatenate([[0], np.cumsum(slot)])
        at = at[2 * (c[at + width] - c[at]) > width]
    return at, T.mix(w[at] + np.uint64(width + (1 << 32))), w2[at]


def _rows(ids, at, wide, h, h2, words, slot, first, **more):
    owner = np.searchsorted(first, at, "right") - 1
    values = [words[a : a + wide][slot[a : a + wide]].view(np.int64) for a in at]
    n = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    cols = {"h": pa.array(h.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "id": ids.take(pa.array(owner)), "pos": pa.array(at - first[owner]), "slots": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(flat))}
    return pa.RecordBatch.from_pydict(cols | {k: pa.array(v[owner]) for k, v in more.items()})


_OUT = "h long, h2 long, id long, pos long, slots array<long>"


def _item_windows(width, least):
    def f(batches):
        for b in batches:
            t, words, slot, first = template(b.column("text"))
            ids, size = b.column("id"), np.diff(first)
            for w in np.unique(np.minimum(size[size >= least], width)):
                own = size >= width if w == width else size == w
                for exact in (False, True):
                    at, h, h2 = _exact_windows(words, first, int(w), slot) if exact else _windows(t, slot, first, int(w))
                    keep = own[np.searchsorted(first, at, "right") - 1]
                    at, h, h2 = at[keep], h[keep], h2[keep]
                    if len(at):
                        yield _rows(ids, at, int(w), h, h2, words, slot & (not exact), first, width=np.full(len(size), w, np.int64), exact=np.full(len(size), exact))

    return f


def _bloom_at(h, bits):
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(34)) & mask).astype(np.int64)


def _bloom(bits):
    def f(table: pa.Table) -> pa.Table:
        on = np.zeros(bits, bool)
        for at in _bloom_at(table.column("h").to_numpy().view(np.uint64), bits):
            on[at] = True
        return pa.table({"bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    return f


def _doc_windows(widths, packed, bits):
    def f(batches):
        on = np.frombuffer(packed, np.uint8)
        hit = lambda at: on[at >> 3] >> (at & 7).astype(np.uint8) & 1
        for b in batches:
            t, words, slot, first = template(b.column("text"))
            for w, exact in widths:
                at, h, h2 = _exact_windows(words, first, w) if exact else _windows(t, slot, first, w)
                p, q = _bloom_at(h, bits)
                keep = np.flatnonzero(hit(p))
                keep = keep[hit(q[keep]) == 1]
                if len(keep):
                    yield _rows(b.column("id"), at[keep], w, h[keep], h2[keep], words, slot & (not exact), first)

    return f


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, need: int = NEED, consistent: float = CONSISTENT) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, same_values of each pair of a document and an item found in it.

    A pair counts if its consistent occurrences match ``need`` of the item's windows,
    or all if it has fewer; or so of its template windows alone, where it has any. An
    item shorter than ``width`` words is one window; one of under LEAST words gives no
    evidence. Null texts have no
    words; rows with a null id take no part; rows of one id count as one document.
    """
    spark = docs.sparkSession
    ship(spark)
    row = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    bench = row(items, "item_id").mapInArrow(_item_windows(width, LEAST), _OUT + ", width long, exact boolean").distinct()
    seen = bench.groupBy("width", "exact").agg(F.count("*").alias("n")).collect()  # at most two rows a width
    n = sum(r.n for r in seen)
    bits = 1 << min(27, max(20, int(64 * n).bit_length()))
    maps = bench.select("h", F.pmod(F.col("h2"), F.lit(8)).alias("part")).groupBy("part").applyInArrow(_bloom(bits), "bits binary").collect()
    packed = np.zeros(bits // 8, np.uint8)
    for r in maps:
        packed |= np.frombuffer(r.bits, np.uint8)
    found = row(docs, "doc_id").mapInArrow(_doc_windows(sorted((r.width, r.exact) for r in seen), packed.tobytes(), bits), _OUT)
    b = bench.select("h", "h2", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.when(~F.col("exact"), F.col("pos")).alias("template_pos"))
    size = b.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"), F.countDistinct("template_pos").alias("item_templates"))
    pairs = found.withColumnRenamed("id", "doc_id").join(b, ["h", "h2"]).withColumn("shift", F.col("pos") - F.col("item_pos")).withColumn("pair", F.arrays_zip("item_slots", "slots"))
    each = pairs.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("item_pos").alias("at"), F.collect_set("template_pos").alias("template_at"), F.array_distinct(F.flatten(F.collect_set("item_slots"))).alias("values"), F.array_distinct(F.flatten(F.collect_set("pair"))).alias("mapped")
    )
    each = each.where(F.size("values") >= F.lit(consistent) * F.size("mapped")).withColumn("same", F.forall("mapped", lambda p: p["item_slots"] == p["slots"]))
    n_of = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    both = each.groupBy("doc_id", "item_id").agg(n_of("at").alias("n_windows"), n_of("template_at").alias("n_templates"), F.max("same").alias("same_values"))
    enough = lambda n, of: (F.col(of) > 0) & (F.col(n) >= F.least(F.lit(need), F.col(of)))
    return both.join(size, "item_id").where(enough("n_windows", "item_windows") | enough("n_templates", "item_templates")).select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("item_windows").cast("long"), "same_values")


def op5_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
