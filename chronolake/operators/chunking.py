"""Cutting captured text into chunks along its lines.

Lines get a kind by pattern, repeated lines go, and lines are packed in order. The
packing depends on what was packed before, so a text is worked by one Python call;
texts are independent and stream through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ship


@dataclass(frozen=True)
class Sizes:
    """Lengths in characters but for tokens; four characters a token."""

    low: int = 300
    high: int = 900
    least_tokens: int = 15
    most_tokens: int = 450
    overlap: float = 0.24

    @property
    def least(self) -> int:
        return 4 * self.least_tokens


# Patterns of line kinds, the first that fits.
KINDS = [
    ("url", re.compile(r"^https?://|www\.", re.I)),
    ("title", re.compile(r"^(?=.{0,119}$).* - ")),
    ("email", re.compile(r"^\s*(from|to|subject|cc|bcc):", re.I)),
    ("search", re.compile(r"^\s*(search[ :]|query:|find )| results for | near me\s*$", re.I)),
    ("code", re.compile(r"^\s*([$>]|(cargo|npm|pnpm|git|fn|let) )| => |::|\{.*\}|\}.*\{|(?=.*\()(?=.*\)).*;", re.I)),
]
ALONE = {"code", "email", "search"}
TEXTS = 128  # texts whose chunks a task holds at a time


def kind_of(line: str) -> str:
    return next((k for k, p in KINDS if p.search(line)), "plain")


def low_signal(line: str) -> bool:
    """Under three letters and digits, or mostly symbols."""
    solid = sum(c.isalnum() for c in line)
    return solid < 3 or solid < 0.4 * len(line.replace(" ", ""))


def windows(text: str, s: Sizes) -> Iterator[str]:
    """Overlapping windows of a text without usable lines, cut at spaces where there is one."""
    size, at = 4 * s.most_tokens, 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = text.rfind(" ", at + size // 2, end)
            end = space if space > 0 else end
        if piece := text[at:end].strip():
            yield piece
        if end == len(text):
            return
        at = max(at + 1, end - int(s.overlap * (end - at)))


def tail(text: str, n: int) -> str:
    """The last n characters, from a word's beginning."""
    if n <= 0 or len(text) <= n:
        return "" if n <= 0 else text
    cut = text[-n:]
    return cut[cut.find(" ") + 1 :] if " " in cut else cut


def chunks(title: str, text: str, s: Sizes = Sizes()) -> list[tuple[str, str]]:
    """(kind, text) of the chunks of one captured text."""
    seen, lines = set(), []
    for raw in [title or "", *(text or "").splitlines()]:
        line = " ".join(raw.split())
        if line and not low_signal(line) and line.lower() not in seen:
            seen.add(line.lower())
            lines.append(("title" if not lines and raw is title else kind_of(line), line))
    if not lines:
        return [("plain", w) for w in windows(" ".join((text or "").split()), s)]
    out: list[tuple[str, str]] = []
    body, kind = "", "plain"

    def close(carry: bool):
        nonlocal body
        if body.strip():
            out.append((kind, body.strip()))
        body = tail(body, int(s.overlap * len(body))) if carry else ""

    for k, line in lines:
        if len(line) > s.high:
            close(False)
            out.extend((k, w) for w in windows(line, s))
            kind = "plain"
            continue
        breaks = k != kind or k in ALONE or (k == "url" and len(body) >= s.least)
        if breaks and len(body) >= s.low:
            close(True)
        body, kind = (f"{body}\n{line}" if body else line), k
        if len(body) >= s.high:
            close(True)
    close(False)
    first: dict[str, tuple[str, str]] = {}
    for c in out:
        first.setdefault(c[1].lower(), c)
    return _joined(list(first.values()), s)


def _joined(parts: list[tuple[str, str]], s: Sizes) -> list[tuple[str, str]]:
    """Chunks under the least length go into the one before them (the first into the next)."""
    out: list[tuple[str, str]] = []
    for kind, text in parts:
        if out and (len(text) < s.least or len(out[-1][1]) < s.least):
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{text}")
        else:
            out.append((kind, text))
    return out


def chunked(df: DataFrame, key: str, title: str, text: str, sizes: Sizes = Sizes()) -> DataFrame:
    """key, chunk_index, kind, text, tokens of every chunk."""
    ship(df.sparkSession)
    types = dict(df.dtypes)

    def f(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # a batch's chunks are never held together
                part = batch.slice(at, TEXTS)
                rows = [(n, i, kind, body, len(body) // 4) for n, (t, x) in enumerate(zip(*[part.column(c).to_pylist() for c in (1, 2)])) for i, (kind, body) in enumerate(chunks(t, x, sizes))]
                n, *cols = zip(*rows) if rows else [()] * 5
                arrays = [part.column(0).take(pa.array(n, pa.int32())), *map(pa.array, cols, (pa.int32(), pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "chunk_index", "kind", "text", "tokens"])

    out = df.select(key, F.coalesce(F.col(title), F.lit("")).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x")).mapInArrow(f, f"key {types[key]}, chunk_index int, kind string, text string, tokens int")
    return out.withColumnRenamed("key", key)


def salient(chunk_rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k chunks of each key with the best line, by line quality, earlier ones first where equal."""
    best = F.array_max(F.transform(F.split("text", "\n"), X.line_quality))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "chunk_index")
    return chunk_rows.withColumn("score", best).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Cues of task types, and titles that name no task.
FOLLOW_UP = ["follow up", "follow-up", "reply to", "reach out", "check in with", "ping "]
REMINDER = ["tomorrow", "today", "tonight", "next week", "next month", "deadline", "due ", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NO_TASK = ["todo", "to do", "task", "follow up", "followup", "reminder", "none", "n a", "no action items", "no followups", "no reminders"]
# Openings of narration that says nothing of its own.
NARRATION = ["the user is", "the user was", "the screen shows", "this screenshot", "the image shows", "user is viewing", "it appears that", "the window displays"]


def task_title(line: Column) -> Column:
    """A line without its list mark (-, *, or a number)."""
    return F.trim(F.regexp_replace(F.trim(line), "^(?:[-*]\\s+|\\d+[.):]\\s+)", ""))


def task_type(title: Column) -> Column:
    t = F.lower(title)
    return F.when(X.contains_any(t, FOLLOW_UP), "followup").when(X.contains_any(t, REMINDER), "reminder").otherwise("todo")


def actionable(title: Column) -> Column:
    n = X.normalise_ascii(title)
    return (F.length(n) >= 6) & (F.size(F.split(n, " ")) >= 2) & ~n.isin(NO_TASK)


def task_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each distinct actionable line of a text as a task: key, title, type."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, "at", task_title(F.regexp_replace("line", "^\\|+|\\|+$", "")).alias("title"))
    rows = lines.where(actionable(F.col("title"))).groupBy(key, X.normalise_ascii(F.col("title")).alias("_k")).agg(F.min_by("title", "at").alias("title"))
    return rows.select(key, "title", task_type(F.col("title")).alias("type"))


def narration(text: Column) -> Column:
    """Text that only describes the screen."""
    t = F.lower(F.trim(text))
    out = F.lit(False)
    for n in NARRATION:
        out = out | t.startswith(n)
    return out


def lexical_shadow(aliases: Column, url: Column, text: Column, budget: int = 320) -> Column:
    """Distinct words of the aliases, then the url, then the text, as far as the budget of characters goes."""
    w = F.array_distinct(F.concat(X.words(F.concat_ws(" ", aliases)), X.words(F.regexp_replace(url, "^[a-z]+://", "")), X.tokens(text)))
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc, x):
        new = F.when(acc["s"] == "", x).otherwise(F.concat(acc["s"], F.lit(" "), x))
        over = acc["full"] | (F.length(new) > budget)
        return F.struct(F.when(over, acc["s"]).otherwise(new).alias("s"), over.alias("full"))

    return F.aggregate(w, start, add, lambda a: a["s"])
