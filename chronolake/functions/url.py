"""URL functions. Two notions of domain exist on purpose: strict (scheme, credentials, port and www. removed) and simple host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(c: Column) -> Column:
    """Lower-case host without scheme, credentials, port or a leading www.; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(c)), "^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, "^www\\.", "")


def page_key(c: Column) -> Column:
    """The url in lower case without http scheme, query, fragment and last slashes: equal for one page."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^https?://", ""), "[?#].*$", ""), "/+$", "")


def host_simple(c: Column) -> Column:
    """What stands between :// and the next slash."""
    return F.regexp_extract(c, "^[^:]+://([^/]+)", 1)


def canonical(c: Column) -> Column:
    """Without fragment, query and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[?#].*$", ""), "/+$", "")


def path_segments(c: Column) -> Column:
    path = F.regexp_extract(c, "^(?:[^:/?#]+://)?[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(F.lower(path), "/"), lambda x: x != "")


def merge_key(c: Column) -> Column:
    """What two visits to one page share: domain and canonical path in lower case."""
    return F.concat(domain(c), F.lower(F.regexp_extract(canonical(c), "^(?:[^:/?#]+://)?[^/?#]*(/.*)?$", 1)))


def query_keys(c: Column) -> Column:
    q = F.regexp_extract(c, "\\?([^#]*)", 1)
    return F.filter(F.transform(F.split(q, "&"), lambda x: F.lower(F.split(x, "=")[0])), lambda x: x != "")
