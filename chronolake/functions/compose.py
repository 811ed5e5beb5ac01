"""Texts that are made out of a record's fields: the compact text, the text to embed, tokens without ground."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a compact text by the source of its summary, sources of good summaries, characters of a text to embed.
COMPACT, GOOD_SUMMARIES, EMBEDDED = {"good": 360, "fallback": 560, "other": 420}, ["llm", "vlm", "vision_mtmd", "vision_fallback"], 2_000
# Labels and columns of the text to embed, and what joins lists.
SEGMENTS = [
    ("intent", "intent", None), ("project", "project", None), ("topic", "topic", None), ("workflow", "workflow", None), ("context", "context", None), ("what_happened", "happened", None), ("why_mattered", "mattered", None), ("what_changed", "changed", None),
    ("context_thread", "thread", None), ("entities", "entities", ", "), ("aliases", "aliases", ", "), ("decisions", "decisions", "; "), ("errors", "errors", "; "), ("blockers", "blockers", "; "), ("todos", "todos", "; "), ("results", "results", "; "), ("files", "files", ", "),
    ("urls", "url", None), ("commands", "commands", "; "),
]


def plain(c: Column) -> Column:
    """Without control characters, single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\p{Cc}]+", " "))


def compact(source: Column, snippet: Column, text: Column) -> Column:
    """A good summary's snippet, else the text, else the snippet, each cut to its source's length."""
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    good = s.isin(GOOD_SUMMARIES)
    other = F.when(s == "fallback", COMPACT["fallback"]).otherwise(COMPACT["other"])
    cut = lambda c, n: F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    short, long = plain(snippet), plain(text)
    return F.when(good & (short != ""), cut(short, COMPACT["good"])).when(long != "", cut(long, other)).otherwise(cut(short, F.when(good, COMPACT["good"]).otherwise(other)))


def embedding_text(row: dict[str, Column]) -> Column:
    """Labelled lines of a record's filled fields; steps stand in for missing todos. row: the columns of SEGMENTS and steps."""
    row = row | {"todos": F.when(F.size(row["todos"]) > 0, row["todos"]).otherwise(row["steps"])}
    parts = []
    for label, name, joint in SEGMENTS:
        value = F.trim(F.coalesce(F.array_join(row[name], joint) if joint else row[name], F.lit("")))
        parts.append(F.when((value != "") & (F.lower(value) != "unknown"), F.concat(F.lit(f"{label}: "), value)))
    return F.substring(F.concat_ws("\n", *parts), 1, EMBEDDED)


def ungrounded(field: Column, evidence: Column) -> Column:
    """The first path, url or qualified name of a field that the evidence does not hold; null if there is none."""
    tokens = F.transform(F.split(field, "\\s+"), lambda t: F.regexp_replace(t, "^[^\\p{L}\\p{N}/:]+|[^\\p{L}\\p{N}/:]+$", ""))
    odd = lambda t: (t != "") & (t.contains("://") | (t.contains("/") & (F.octet_length(t) > 4)) | (t.contains("::") & (F.octet_length(t) > 4))) & ~evidence.contains(t)
    return F.get(F.filter(tokens, odd), F.lit(0))
