"""Source divergence audit by two-dimensional group-block tiling.

A group is a (lang, source). Map tasks count terms inside each group before
anything is shuffled. Terms in at least ``LEAST`` documents of a lang are its
vocabulary, cut by hash into chunks of about ``CHUNK`` terms; the groups of a
lang are cut by hash into blocks of about ``BLOCK``. The counts of one block in
one chunk are packed into one row. Each packed row goes to every tile (block by
block) of its lang, in strips of ``STRIP`` chunks; a task reads its tiles sorted,
one chunk at a time, and adds up the tile's pair submatrix, so what it holds
depends on BLOCK and CHUNK alone. Terms that neither block has are counted, not
stored. Strips are added up afterwards.

All arithmetic is on whole numbers: a share p is 1 + floor(SCALE * (n + 1) / m)
by long division in three steps, exact for m under 9 * 10**15.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import _text as T
from ._work import dropped, stored

SCALE = 1_000_000_000
LEAST, TOP = 3, 200
BLOCK, CHUNK, STRIP = 16, 4096, 4  # groups of a block, terms of a chunk, chunks of a strip
FLUSH = 200_000  # terms that a map task counts before it passes them on
FEW = 1_000  # langs that may be broadcast
_WORD = re.compile(b"[a-z\x80-\xff]+")
_LOWER = bytes(T.LOWER)


def _counted(batches):
    """(lang, source, term, n, d): occurrences and documents of terms, added up as far as FLUSH allows; a row without term for each group."""
    groups: dict = {}
    held = 0

    def flush():
        lang, source, term, n, d = [], [], [], [], []
        for (x, y), (count, seen) in groups.items():
            k = len(count) + 1  # the last row is the group's own, without term
            lang += [x] * k
            source += [y] * k
            term += [*count, None]
            n += [*count.values(), 0]
            d += [*map(seen.__getitem__, count), 0]
        term = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), term, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "d"])

    for b in batches:
        data, off = T.buffers(b.column("text"))
        names = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()))
        for i, g in enumerate(names):
            words = _WORD.findall(data[off[i] : off[i + 1]].tobytes().translate(_LOWER))
            n, d = groups.setdefault(g, ({}, {}))
            before = len(n)
            for w in words:
                n[w] = n.get(w, 0) + 1
            for w in set(words):
                d[w] = d.get(w, 0) + 1
            held += len(n) - before
            if held > FLUSH:
                yield flush()
                groups, held = {}, 0
    if groups:
        yield flush()


def share(n: str, m: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 1) / m) without overflow: three digits of base 1000."""
    rest = lambda x: f"(({x}) * 1000 % {m})"
    digit = lambda x: f"(({x}) * 1000 div {m})"
    a = f"({n} + 1)"
    b, c = rest(a), rest(rest(a))
    return f"(1 + {digit(a)} * 1000000 + {digit(b)} * 1000 + {digit(c)})"


def shares(n: np.ndarray, m) -> np.ndarray:
    out, rest = 0, n.astype(np.int64) + 1
    for _ in range(3):
        rest = rest * 1000
        digit = rest // m
        out, rest = out * 1000 + digit, rest - digit * m
    return out + 1


def _pack(table: pa.Table) -> pa.Table:
    """All counts of one block in one chunk as one row: the sources' names, and for each count its source, term and number."""
    names = table.column("source").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.chunk(0)
    bits = [names.indices.to_numpy(zero_copy_only=False).astype("<i4"), table.column("t").to_numpy().astype("<i4"), table.column("n").to_numpy().astype("<i8")]
    keys = {c: table.column(c)[:1] for c in ("lang", "block", "chunk")}
    return pa.table(keys | {"names": pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())), "counts": pa.array([b"".join(x.tobytes() for x in bits)], pa.binary())})


def _unpacked(row, index):
    """(row of the block, term, number) of every count of a packed row."""
    raw = row["counts"]
    k = len(raw) // 16
    g, t, n = np.frombuffer(raw, "<i4", k), np.frombuffer(raw, "<i4", k, 4 * k), np.frombuffer(raw, "<i8", k, 8 * k)
    return np.array([index[x] for x in row["names"]], np.int64)[g], t.astype(np.int64), n


class _Tile:
    """One block-by-block submatrix over the chunks of a strip."""

    def __init__(self):
        self.sides: dict[int, tuple[dict, np.ndarray]] = {}
        self.sums, self.left = None, 0

    def head(self, row):
        own = row["heads"]
        self.sides[row["block"]] = ({x["source"]: k for k, x in enumerate(own)}, np.array([x["m"] for x in own], np.int64))
        self.left = row["terms"]

    def matrices(self):
        """(blocks, one or two; the two sums)."""
        blocks = sorted(self.sides)
        a, b = blocks[0], blocks[-1]
        if self.sums is None:
            shape = (len(self.sides[a][1]), len(self.sides[b][1]))
            self.sums = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        return a, b, *self.sums

    def add(self, pa_, pb, times=1):
        """pa_, pb: shares of both blocks' groups over the same terms."""
        a, b, there, back = self.matrices()
        for g in range(len(pa_)):
            d = pa_[g][None, :] - pb
            d *= d
            there[g] += (d // pb).sum(axis=1) * times  # of the group of block a against that of block b
            if a != b:
                back[g] += (d // pa_[g][None, :]).sum(axis=1) * times

    def chunk(self, rows):
        a, b, *_ = self.matrices()
        got = {r["block"]: _unpacked(r, self.sides[r["block"]][0]) for r in rows}
        terms = np.unique(np.concatenate([t for _, t, _ in got.values()]))
        dense = {}
        for block in {a, b}:
            m = self.sides[block][1]
            n = np.zeros((len(m), len(terms)), np.int64)
            if block in got:
                g, t, k = got[block]
                n[g, np.searchsorted(terms, t)] = k
            dense[block] = shares(n, m[:, None])
        self.add(dense[a], dense[b])
        self.left -= len(terms)

    def rows(self):
        a, b, there, back = self.matrices()
        if self.left:
            none = {k: shares(np.zeros((len(m), 1), np.int64), m[:, None]) for k, (_, m) in self.sides.items()}
            self.add(none[a], none[b], self.left)
        names_a, names_b = list(self.sides[a][0]), list(self.sides[b][0])
        for g, x in enumerate(names_a):
            for h, y in enumerate(names_b):
                if a != b or g != h:
                    yield x, y, int(there[g, h])
                if a != b:
                    yield y, x, int(back[g, h])


def _tiles(batches):
    """Sums of the pairs of every tile; rows come sorted by tile, chunk and block, a tile's heads first."""
    key = tile = chunk = None
    rows: list = []

    def done():
        if tile is not None and {key[1], key[2]} == set(tile.sides):  # a block that no group falls into has no tiles
            if rows:
                tile.chunk(rows)
            got = list(tile.rows())
            if got:
                x, y, v = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(x), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(v, pa.int64())], ["lang", "source", "item", "value"])

    for b in batches:
        for k in range(b.num_rows):
            r = {c: b.column(c)[k].as_py() for c in b.schema.names}
            now = (r["lang"], r["a"], r["b"], r["strip"])
            if now != key:
                yield from done()
                key, tile, chunk, rows = now, _Tile(), None, []
            if r["chunk"] < 0:
                tile.head(r)
                continue
            if len(tile.sides) < len({key[1], key[2]}):
                continue
            if r["chunk"] != chunk and rows:
                tile.chunk(rows)
                rows = []
            chunk = r["chunk"]
            rows.append(r)
    yield from done()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far each group is from each other group of its lang, and its terms that stand out from the lang.

    docs has text, lang and source; nulls are empty strings, other columns are
    ignored. Every row is a document, repeated rows too. A group without terms has
    its pairs; a lang without vocabulary has pairs of value 0 and no terms. A lang
    of one source has no pairs. Ties go to the smaller item in UTF-8. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    raw = docs.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    counts = stored(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "audit-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("d").alias("d")).where(F.col("d") >= least).drop("d")
    kept = stored(kept, "audit-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("ln").alias("lang_n"))
    if langs.count() <= FEW:  # so many rows of three short fields fit anywhere; else the terms are dealt out by lang
        langs = F.broadcast(langs)
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK).cast("long")).cast("int")
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term"))
    terms = stored(kept.join(langs, "lang").withColumn("chunk", chunk).select("lang", "term", "ln", "chunk", place.alias("t")), "audit-terms")
    dropped(kept)
    known = stored(counts.where("term is not null").drop("d").join(terms, ["lang", "term"]), "audit-known")
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("gn"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("ln").alias("lang_n"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["gn", "v", "lang_n"])
    groups = stored(groups.withColumns({"m": F.col("gn") + F.col("v"), "lm": F.col("lang_n") + F.col("v")}), "audit-groups")
    dropped(counts)
    parts = _pairs(groups, known, terms).unionByName(_terms(groups, known, top))
    return parts


def _terms(groups: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """The group's terms over the lang's share, best first; a group's best are found in each chunk, then among those."""
    rows = known.join(groups.select("lang", "source", "m", "lm"), ["lang", "source"])
    rows = rows.withColumns({"p": F.expr(share("n", "m")), "q": F.expr(share("ln", "lm"))}).where("p > q")
    rows = rows.select("lang", "source", "chunk", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", best("lang", "source", "chunk")).where(F.col("rank") <= top)
    return rows.withColumn("rank", best("lang", "source")).where(F.col("rank") <= top).drop("chunk")


def _pairs(groups: DataFrame, known: DataFrame, terms: DataFrame) -> DataFrame:
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    strip = F.floor(F.col("chunk") / STRIP).cast("int")
    own = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("nb").cast("long")).cast("int"))
    own = stored(own.select("lang", "source", "m", "block", "nb"), "audit-blocks")
    heads = own.groupBy("lang", "block", "nb").agg(F.sort_array(F.collect_list(F.struct("source", "m"))).alias("heads"))
    strips = terms.groupBy("lang", strip.alias("strip")).agg(F.count("*").alias("terms"))
    # a lang without vocabulary has one strip without terms
    strips = strips.unionByName(blocks.select("lang").join(strips, "lang", "left_anti").select("lang", F.lit(0).alias("strip"), F.lit(0).cast("long").alias("terms")))
    heads = heads.join(strips, "lang").select("lang", "block", "nb", "strip", F.lit(-1).alias("chunk"), "heads", "terms", F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("binary").alias("counts"))
    cells = known.join(own.drop("m", "nb"), ["lang", "source"]).select("lang", "block", "chunk", "source", "t", "n")
    packed = cells.groupBy("lang", "block", "chunk").applyInArrow(_pack, "lang string, block int, chunk int, names array<string>, counts binary")
    packed = packed.join(blocks, "lang").select("lang", "block", "nb", strip.alias("strip"), "chunk", F.lit(None).cast(heads.schema["heads"].dataType).alias("heads"), F.lit(None).cast("long").alias("terms"), "names", "counts")
    tiles = heads.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = tiles.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("nb", "other")
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(n, "lang", "a", "b", "strip").sortWithinPartitions("lang", "a", "b", "strip", "chunk", "block")
    sums = tiles.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


ORACLE = r"""WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lang_n FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS gn FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.gn + l.v) AS p, 1 + 1000000000 * (k.ln + 1) // (l.lang_n + l.v) AS q
  FROM g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def op12_source_divergence(spark, sf_dir) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
