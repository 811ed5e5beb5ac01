"""Which project a record belongs to: from its own field, paths, titles and urls, in that order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that stand right below a project's own, folders that are no project, what precedes or follows a project's name in a url.
MARKERS = "src src-tauri app apps lib libs crates packages pkg client server backend frontend components tests test docs".split()
GENERIC = "users user home workspace workspaces repo repos repository repositories project projects desktop documents downloads code dev tmp private var opt applications library volumes".split()
URL_MARKERS = "project projects repo repos repository repositories".split()
URL_CHILDREN = "pull pulls issues merge_requests mr commit commits tree blob compare actions wiki security releases tags branches graphs pulse network stargazers forks watchers".split()
#: A path inside a text: folders and a last part.
PATH = "(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+(?:\\.[A-Za-z0-9._-]+)?"


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[^\\p{L}\\p{N}_-]+|[^\\p{L}\\p{N}_-]+$", "")


def meaningful(segment: Column) -> Column:
    """A part of a path that may be a project's name."""
    return _let(_bare(segment), lambda x: (x != "") & ~F.lower(x).isin(GENERIC + MARKERS) & ~x.contains("."))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p)), lambda p: p != "")


def slug_of_path(path: Column) -> Column:
    """The first folder that stands right above one of MARKERS; null if there is none."""
    return _let(segments(path), lambda s: _first(F.transform(s, lambda x, i: F.when((i >= 1) & x.isin(MARKERS) & meaningful(F.get(s, i - 1)), F.get(s, i - 1)))))


def slug_of_url(url: Column) -> Column:
    """What follows /projects/, /repos/ or the like; else the second part of owner/name/issues and the like."""
    raw = F.trim(url)
    rest = F.regexp_replace(F.coalesce(F.get(F.split(raw, "://"), F.lit(1)), raw), "^/+", "")
    parts = F.split(rest, "/")
    below = F.transform(F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.regexp_replace(p, "(\\.git)+$", ""))
    ways = F.array(*[F.lit(m) for m in URL_MARKERS])

    def found(v: Column) -> Column:
        s, low = v["s"], v["low"]
        named = _first(F.transform(ways, lambda m: _let(F.get(s, F.nullif(F.array_position(low, m), F.lit(0).cast("long")).cast("int")), lambda a: F.when(meaningful(a), a))))
        return F.coalesce(named, F.when((F.size(s) >= 3) & F.get(low, F.lit(2)).isin(URL_CHILDREN) & meaningful(F.get(s, F.lit(1))), F.get(s, F.lit(1))))

    return F.when(raw != "", _let(_let(below, lambda s: F.struct(s.alias("s"), F.transform(s, lambda p: F.lower(p)).alias("low"))), found))


def project_name(slug: Column) -> Column:
    """The name to show: short ones in capitals, longer ones with each part's first letter large; null if it is no name."""
    large = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))
    parts = lambda x: F.filter(F.transform(F.split(x, "[-_]"), lambda p: F.trim(p)), lambda p: p != "")
    short = lambda p: (F.octet_length(p) <= 5) & p.rlike("^[A-Za-z0-9]+$")
    one = lambda p: F.when(short(p), F.upper(p)).otherwise(large(p))
    shown = lambda v: F.when(F.size(v) > 1, F.array_join(F.transform(v, large), " ")).when(F.size(v) == 1, one(F.get(v, F.lit(0))))
    return _let(_bare(F.regexp_replace(F.trim(slug), "(\\.git)+$", "")), lambda x: F.when(meaningful(x), _let(parts(x), shown)))


def of_path(path: Column) -> Column:
    return project_name(slug_of_path(path))


def in_text(text: Column) -> Column:
    """The project of the first path in a text that tells one."""
    return _first(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PATH})"), F.lit(1)), of_path))


def inferred(project: Column, files: Column, text: Column, title: Column, url: Column) -> Column:
    """The record's own project, else that of its files, of paths in its text, in its title, or of its url."""
    own = F.trim(project)
    return F.coalesce(F.when(own != "", own), _first(F.transform(files, of_path)), in_text(text), in_text(title), project_name(slug_of_url(url)))
