"""Chunks, tasks and shadows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..sources.memory import table
from .registry import query


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "text")


@query("t19_chunks")
def _(spark, d):
    return C.chunked(_docs(spark, d), "doc_id", "source", "text").select("doc_id", "chunk_index", "kind", "tokens", F.md5("text").alias("text"))


@query("t20_salient_chunks")
def _(spark, d):
    return C.salient(C.chunked(_docs(spark, d), "doc_id", "source", "text"), "doc_id", 3).select("doc_id", "rank", "chunk_index", F.round("score", 6).alias("score"))


@query("t21_narration", "WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' The user is ' || text WHEN 1 THEN 'THE SCREEN SHOWS ' || text ELSE text END AS text FROM documents) SELECT doc_id FROM x WHERE starts_with(lower(trim(text)), 'the user is') OR starts_with(lower(trim(text)), 'the screen shows')")
def _(spark, d):
    k, text = F.col("doc_id") % 5, F.col("text")
    told = F.when(k == 0, F.concat(F.lit(" The user is "), text)).when(k == 1, F.concat(F.lit("THE SCREEN SHOWS "), text)).otherwise(text)
    return _docs(spark, d).where(C.narration(told)).select("doc_id")


@query("t24_task_types", "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%reply to%' THEN 'followup' WHEN lower(o_orderpriority) LIKE '%due %' OR lower(o_orderpriority) LIKE '%today%' THEN 'reminder' ELSE 'todo' END AS type FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.task_type(F.col("o_orderpriority")).alias("type"))


@query("t24_task_lines")
def _(spark, d):
    return C.task_lines(table(spark, d, "conversations").select("conv_id", "text"), "conv_id", "text")


@query("t16_lexical_shadow")
def _(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", C.lexical_shadow(F.array("source"), F.concat(F.lit("https://e.org/"), "source"), F.col("text")).alias("shadow"))
