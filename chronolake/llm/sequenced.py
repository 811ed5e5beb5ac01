"""Sequenced change applier: a keyed Structured Streaming query with paged MapState.

Changes of a client carry numbers n without gaps (dense ranks of seq). A client
applies n = next; later ones are held until the gap closes, or until the earliest
held change has waited ``GRACE`` days, when next jumps to the least held n.

Clients are dealt by hash over buckets of about ``CLIENTS``; a bucket is a key of
the stream. Its state: a ValueState (next, city and balance of its clients as one
Arrow blob; the least day of every page) and a MapState page -> (least day, Arrow
blob of the changes held). A page is a span of ``PAGE`` numbers. Only pages that a
batch touches are loaded, at most ``CACHE`` of them at once, so a client of any
size is served from a few pages, and small clients share the cost of a call.

A batch need not be sorted inside a client: of the rows of one n the first by
(day, change_id) is held, whichever comes first in the stream, since a row held by
the same batch gives way to an earlier one. Jumps happen only where a batch
begins. Buckets that are due for a jump but have no rows in the batch get a tick
row; which are due follows from the least days that earlier starts put out. The
last batch's start ends with the jumps over all gaps that are left, so every bucket
that holds anything is in it.

The dense ranks are found without a task for a whole client: (client, seq) pairs
are range partitioned, numbered inside each range and shifted by the client's
pairs in earlier ranges. The source of the stream, its checkpoint and its output
are tables in a new folder under spark.checkpoint.dir; each batch is a new start.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship
from ._work import folder, partitions, stored

BATCHES, FIRST_DAY, SPAN, GRACE = 8, 19723, 160, 5
PAGE, CACHE = 512, 64  # numbers of a page; pages of one bucket in memory
CLIENTS = 256  # of a bucket, on average
FLUSH = 10_000  # rows put out at once
_ALWAYS = 1 << 30  # a day after all days
_FEED = "bucket long, client string, batch int, due int, n long, day int, change_id long, op string, city string, balance double, known boolean"
_OUT = "bucket long, client string, change_id long, status string, batch int, missed long, n long, op string, city string, cents long, day int"
_HELD = pa.schema([("client", pa.string()), ("n", pa.int64()), ("batch", pa.int32()), ("day", pa.int32()), ("change_id", pa.int64()), ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64())])
_CLIENTS = pa.schema([("client", pa.string()), ("next", pa.int64()), ("city", pa.string()), ("balance", pa.float64())])
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a commit writes what changed, not the whole store
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def cents(balance):
    """floor(100 * balance + 0.5); null for what is no number of cents."""
    if balance is None or not math.isfinite(balance) or abs(balance) > 9e16:
        return None
    return math.floor(100 * balance + 0.5)


def _blob(rows: list, schema: pa.Schema) -> bytes:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema).serialize().to_pybytes()


def _rows(blob: bytes, schema: pa.Schema):
    return zip(*[c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(blob), schema).columns])


class _Bucket:
    """One bucket's state during one batch. A held change is (batch, day, change_id, op, city, balance)."""

    def __init__(self, key: int, meta, pages, span: int, most: int):
        self.key, self.pages, self.span, self.most = key, pages, span, most
        self.batch, known, days = meta or (0, None, b"")
        self.clients = {c: x for c, *x in _rows(known, _CLIENTS)} if known else {}  # client -> [next, city, balance]
        days = np.frombuffer(days, np.int64).reshape(-1, 2)
        self.least = dict(zip(days[:, 0].tolist(), days[:, 1].tolist()))  # page -> least day held
        self.waited = bool(self.least)
        self.cache: dict[int, dict] = {}
        self.dirty: set[int] = set()
        self.out: list[tuple] = []

    def page(self, p: int) -> dict:
        if p not in self.cache:
            if len(self.cache) >= self.most:
                old = next(iter(self.cache))
                self.save(old)
                del self.cache[old]
            self.cache[p] = {(c, n): tuple(x) for c, n, *x in _rows(self.pages.getValue((p,))[1], _HELD)} if p in self.least else {}
        return self.cache[p]

    def save(self, p: int) -> None:
        if p in self.dirty:
            self.dirty.discard(p)
            held = self.cache[p]
            if held:
                self.least[p] = min(x[1] for x in held.values())
                self.pages.updateValue((p,), (self.least[p], _blob([(*k, *x) for k, x in held.items()], _HELD)))
            elif p in self.least:
                del self.least[p]
                self.pages.removeKey((p,))

    def meta(self) -> tuple:
        for p in list(self.cache):
            self.save(p)
        return self.batch, _blob([(c, *x) for c, x in self.clients.items()], _CLIENTS), np.array(list(self.least.items()), np.int64).tobytes()

    def put(self, client, change_id, status, missed, n, op, city, amount) -> None:
        self.out.append((self.key, client, change_id, status, self.batch, missed, n, op, city, amount, 0))

    def apply(self, client: str, n: int) -> None:
        p = n // self.span
        _, _, change_id, op, city, balance = self.page(p).pop((client, n))
        self.dirty.add(p)
        state = self.clients[client]
        if op == "D":
            state[1:] = None, None
        elif op == "I":
            state[1:] = city, balance
        elif op == "U":
            state[1:] = state[1] if city is None else city, state[2] if balance is None else balance
        missed, state[0] = n - state[0], n + 1
        self.put(client, change_id, "applied", missed, n, op, state[1], cents(state[2]))

    def run(self, client: str):
        """Apply next as long as it is held."""
        state = self.clients[client]
        while True:
            p = state[0] // self.span
            if p not in self.cache and p not in self.least or (client, state[0]) not in self.page(p):
                return
            self.apply(client, state[0])
            yield from self.full()

    def jump(self, due: int):
        """Apply every held n of a client up to its largest that is due, over all gaps: what repeated jumps to the least held n come to."""
        last: dict[str, int] = {}
        for p in sorted(p for p, day in self.least.items() if day <= due):
            for (c, n), x in self.page(p).items():
                if x[1] <= due:
                    last[c] = max(n, last.get(c, 0))
        if last:
            top = max(last.values()) // self.span
            for p in sorted(p for p in self.least if p <= top):
                for c, n in sorted(k for k in self.page(p) if k[1] <= last.get(k[0], 0)):
                    self.apply(c, n)
                    yield from self.full()
            for c in last:
                yield from self.run(c)

    def hold(self, client: str, n: int, new: tuple) -> None:
        """Hold a change, or reject it, or reject a later one that this batch held for the same n."""
        state = self.clients.setdefault(client, [1, None, None])
        if n >= state[0]:
            held = self.page(n // self.span)
            old = held.get((client, n))
            if old is None or old[0] == self.batch and _order(new) < _order(old):
                held[client, n] = new
                self.dirty.add(n // self.span)
                if old is None:
                    return
                new = old
        self.put(client, new[2], "rejected", 0, n, new[3], None, None)

    def full(self, least: int = FLUSH):
        if len(self.out) >= least:
            columns = zip(*self.out)
            yield pd.DataFrame({f.split()[0]: pd.Series(c, dtype="object" if f.split()[1] == "string" or f.startswith("cents") else None) for f, c in zip(_OUT.split(", "), columns)})
            self.out = []


def _order(x):
    return x[1], x[2], *((v is not None, v if v is not None else other) for v, other in zip(x[3:], ("", "", 0.0)))


class Applier(StatefulProcessor):
    """handleInputRows gets the feed's rows of one bucket and batch; due is the latest day whose held changes make next jump. A tick has n 0."""

    def __init__(self, page: int = PAGE, cache: int = CACHE, last: int = BATCHES):
        self.page, self.cache, self.last = page, cache, last

    def init(self, handle) -> None:
        self.meta = handle.getValueState("bucket", "batch int, clients binary, days binary")
        self.pages = handle.getMapState("pages", "page long", "least int, held binary")

    def handleInputRows(self, key, rows, timerValues):
        b, touched = None, set()
        for df in rows:
            if b is None:
                b = _Bucket(int(key[0]), self.meta.get(), self.pages, self.page, self.cache)
                if df["batch"].iloc[0] > b.batch:
                    b.batch = int(df["batch"].iloc[0])
                    yield from b.jump(int(df["due"].iloc[0]))
            fields = [df[c].tolist() for c in ("client", "n", "day", "change_id", "op", "city", "balance", "known")]
            for client, n, day, change_id, op, city, balance, known in zip(*fields):
                if n:
                    touched.add(client)
                    b.hold(client, n, (b.batch, day, change_id, op, city, balance if known else None))
            yield from b.full()
        for client in touched:
            yield from b.run(client)
        if b.batch == self.last:
            b.batch += 1
            yield from b.jump(_ALWAYS)
        self.meta.update(b.meta())
        if b.least or b.waited:
            b.out.append((b.key, "", 0, "held", b.batch, 0, 0, None, None, None, min(b.least.values(), default=_ALWAYS + 1)))
        yield from b.full(1)

    def close(self) -> None:
        pass


def dense_ranks(rows: DataFrame) -> DataFrame:
    """(client, seq, n): n is the dense rank of seq inside the client, a null seq first. No task gets more of a client than a range of it."""
    pairs = rows.select("client", "seq").distinct().repartitionByRange(partitions(rows.sparkSession), "client", "seq")
    pairs = stored(pairs.withColumn("part", F.spark_partition_id()), "sequence-pairs")
    before = Window.partitionBy("client").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pairs.groupBy("client", "part").agg(F.count("*").alias("k")).select("client", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("client", "part").orderBy(F.asc_nulls_first("seq")))
    return pairs.withColumn("place", place).join(counts, ["client", "part"]).select("client", "seq", (F.col("place") + F.col("before")).alias("n"))


def prepared(changes: DataFrame) -> DataFrame:
    """The feed's rows, without due: distinct changes, numbered, without those that vanish, with day and batch."""
    kinds = {"change_id": "long", "client_id": "long", "seq": "long", "op": "string", "source": "string", "segment": "string", "city": "string", "balance": "double"}
    rows = changes.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], "valid_at").distinct()
    rows = stored(rows.withColumn("client", F.coalesce(F.col("client_id").cast("string"), F.lit(""))), "sequence-rows")
    ranks = dense_ranks(rows).withColumnsRenamed({"client": "c", "seq": "s"})
    rows = rows.join(ranks, (F.col("client") == F.col("c")) & F.col("seq").eqNullSafe(F.col("s")))
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    rows = rows.where(F.col("valid_at").isNotNull() & (h % 11 != 0))
    rows = rows.withColumn("day", (F.unix_date(F.to_date("valid_at")) + 2 * (h % 4)).cast("int"))
    clients = rows.agg(F.approx_count_distinct("client")).first()[0]
    buckets = max(4 * partitions(rows.sparkSession), clients // CLIENTS)
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / SPAN))).cast("int")
    return rows.select(F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket"), "client", batch.alias("batch"), "n", "day", "change_id", "op", "city", F.coalesce("balance", F.lit(0.0)).alias("balance"), F.col("balance").isNotNull().alias("known"))


def apply_changes(changes: DataFrame, page: int = PAGE, cache: int = CACHE) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current (and n) of every change that does not vanish.

    Rows alike in all columns are one change. Changes without valid_at or change_id
    vanish after numbers are given, as those of hash remainder 0 do. Rows of a null
    client_id are one client; a null seq comes first; days before the first batch
    belong to it. An unknown or null op is applied and sets nothing. Two changes of
    one n, day and change_id are taken in order of op, city and balance, nulls first.
    A balance that is no finite number gives null cents. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = changes.sparkSession
    ship(spark)
    at = f"{folder(spark)}/sequenced-{uuid.uuid4().hex}"
    rows = stored(prepared(changes), "sequence-feed")
    found = {r.batch: (r.n, r.day) for r in rows.groupBy("batch").agg(F.count("*").alias("n"), F.max("day").alias("day")).collect()}  # BATCHES rows at most
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        started, latest = False, None
        for batch in range(1, BATCHES + 1):
            due = -_ALWAYS if latest is None else latest - GRACE
            feed = rows.where(F.col("batch") == batch).select("bucket", "client", "batch", F.lit(due).alias("due"), "n", "day", "change_id", "op", "city", "balance", "known")
            ticks = _due(spark, at, batch, due) if started else None
            if ticks is not None:
                feed = feed.unionByName(ticks)
            if batch in found or ticks is not None and not ticks.isEmpty():
                _start(spark, feed, at, Applier(page, cache))
                started = True
            if batch in found:
                latest = max(found[batch][1], latest or found[batch][1])
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not started:
        return spark.createDataFrame([], "change_id long, client_id long, status string, batch int, missed long, city string, cents long, current boolean, n long")
    out = spark.read.schema(_OUT).parquet(f"{at}/out").where("status in ('applied', 'rejected')")
    last = out.where("status = 'applied'").groupBy("client").agg(F.max("n").alias("last")).withColumnRenamed("client", "c")
    current = (F.col("status") == "applied") & F.col("last").isNotNull() & ~F.col("op").eqNullSafe(F.lit("D"))
    out = out.join(last, (F.col("client") == F.col("c")) & (F.col("n") == F.col("last")), "left")
    return out.select("change_id", F.when(F.col("client") != "", F.col("client")).cast("long").alias("client_id"), "status", "batch", "missed", "city", "cents", current.alias("current"), "n")


def _due(spark, at: str, batch: int, due: int) -> DataFrame:
    """Tick rows of the buckets whose earliest held change is due, by the last word of the starts so far; in the last batch of all that hold any."""
    told = spark.read.schema(_OUT).parquet(f"{at}/out").where("status = 'held'")
    last = told.groupBy("bucket").agg(F.max_by("day", "batch").alias("day")).where(F.col("day") <= (_ALWAYS if batch == BATCHES else due))
    none = {"client": "''", "batch": batch, "due": due, "n": 0, "day": 0, "change_id": 0, "op": "null", "city": "null", "balance": "0.0", "known": "false"}
    kinds = dict(f.split() for f in _FEED.split(", "))
    return last.select("bucket", *[F.expr(f"CAST({v} AS {kinds[c]})").alias(c) for c, v in none.items()])


def _start(spark, feed: DataFrame, at: str, applier: Applier) -> None:
    """Add a batch to the source and start the query on it; it ends when it has read what is there."""
    feed.write.mode("append").parquet(f"{at}/feed")
    out = spark.readStream.schema(_FEED).parquet(f"{at}/feed").groupBy("bucket").transformWithStateInPandas(applier, _OUT, "append", "none")
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def op13_sequenced_changes(spark, sf_dir) -> DataFrame:
    out = apply_changes(spark.read.parquet(f"{sf_dir}/client_changes.parquet"))
    return out.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")
