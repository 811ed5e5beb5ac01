"""Stable ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(url: Column, title: Column, ms: Column) -> Column:
    """sha256 of url | title | five-minute slot."""
    return F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.floor(ms / 300_000).cast("long").cast("string")), 256)


def stable_id(*parts: Column) -> Column:
    """An id that follows from its parts alone."""
    return F.substring(F.sha2(F.concat_ws("␟", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def session_key(app: Column, project: Column, ms: Column) -> Column:
    """App, project and the half-hour slot."""
    return F.concat_ws(":", F.lower(app), F.lower(F.coalesce(project, F.lit(""))), F.floor(ms / 1_800_000).cast("long").cast("string"))


def fingerprint(c: Column) -> Column:
    """A 64-bit fingerprint of a source (xxHash64 in place of FNV-1a)."""
    return F.xxhash64(c)
