"""Text functions as Column expressions. All stay inside code generation or Spark's array functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOP_WORDS = (
    "a an and are as at be but by can could did do does for from had has have he her his how i in into is it its just me my of on or our "
    "she should so than that the their them then there these they this to up us was we were what when where which who why will with would you your"
).split()


def normalise(c: Column) -> Column:
    """Lower case; all but letters, digits and spaces become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def normalise_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def alias_key(c: Column) -> Column:
    """Key of an alias: keeps letters, digits and / . _ -; what is between them becomes one ':', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{N}/._-]+", ":"), "^:|:$", "")


def words(c: Column) -> Column:
    """Normalised words, in order; an empty text has none."""
    return F.filter(F.split(normalise(c), " "), lambda w: w != "")


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` characters that are no stop words."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= least) & ~w.isin(STOP_WORDS)))


def trim_to(c: Column, n: int) -> Column:
    """At most n characters; a cut text ends in three dots (alone, where n is under three)."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, max(0, n - 3)), F.lit("...")))


def drop_middle(c: Column) -> Column:
    """The word without its middle character; words of up to three stay."""
    mid = F.floor(F.length(c) / 2).cast("int")
    return F.when(F.length(c) <= 3, c).otherwise(F.concat(F.substring(c, F.lit(1), mid), F.substring(c, mid + 2, F.length(c))))


def prefix(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.substring(c, 1, n))


def char_ngrams(c: Column, n: int) -> Column:
    """Every run of n characters; none if the word is shorter."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def stem(c: Column) -> Column:
    """Suffix stemmer: ies to y, then ing, ed, es, s, each with a least length (in bytes)."""
    n = F.octet_length(c)
    cut = lambda k: F.substring(c, F.lit(1), F.length(c) - k)
    return (
        F.when((n > 4) & c.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & c.endswith("ing"), cut(3))
        .when((n > 4) & c.endswith("ed"), cut(2))
        .when((n > 4) & c.endswith("es"), cut(2))
        .when((n > 3) & c.endswith("s"), cut(1))
        .otherwise(c)
    )


def singular(c: Column) -> Column:
    """ies to y in words over four bytes, else without a last s in words over three."""
    n, cut = F.octet_length(c), lambda k: F.substring(c, F.lit(1), F.length(c) - k)
    return F.when((n > 4) & c.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 3) & c.endswith("s"), cut(1)).otherwise(c)


def plural(c: Column) -> Column:
    n = F.length(c)
    return F.when(c.endswith("y"), F.concat(F.substring(c, F.lit(1), n - 1), F.lit("ies"))).when(c.endswith("s"), c).otherwise(F.concat(c, F.lit("s")))


def stemmed(c: Column) -> Column:
    """Distinct words and their stems."""
    w = words(c)
    return F.array_distinct(F.concat(w, F.transform(w, stem)))


def symbol_ratio(c: Column) -> Column:
    """Share of characters that are neither letter, digit nor white space; 1 for an empty text."""
    n = F.length(F.regexp_replace(c, "\\s+", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(c, "[\\p{L}\\p{N}\\s]+", "")) / n)


def alpha_ratio(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, "\\s+", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, "[^\\p{L}]+", "")) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words of an array."""
    n = F.size(w)
    return F.when(n >= 2, F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda x, y: F.concat(x, F.lit(" "), y)))).otherwise(F.array().cast("array<string>"))


def acronym(c: Column) -> Column:
    """First letters of the words, for two to eight words."""
    w = words(c)
    return F.when(F.size(w).between(2, 8), F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))


def sentences(c: Column) -> Column:
    """Trimmed sentences, cut after . ! ? and at newlines."""
    return F.filter(F.transform(F.split(c, "(?<=[.!?])\\s+|\\n+"), lambda s: F.trim(s)), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def contains_any(c: Column, parts) -> Column:
    """Whether a text contains any of the given literal parts."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts], F.lit(False))


def merge_lists(a: Column, b: Column) -> Column:
    """Trimmed items of both lists in order; of items alike but for case the first stays, blanks go."""
    both = F.filter(F.transform(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != "")
    lowered = F.transform(both, lambda x: F.lower(x))
    return F.filter(both, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def merge_story(a: Column, b: Column, most: int = 4000) -> Column:
    """Lines of both texts, each once, up to ``most`` characters."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.concat_ws("\n", a, b), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.substring(F.array_join(lines, "\n"), 1, most)


def named_entities(c: Column) -> Column:
    """Distinct words of over two bytes, without marks at their ends, that begin with a capital; in lower case."""
    long = lambda x: F.octet_length(x) > 2
    bare = F.transform(F.filter(F.split(c, "\\s+"), long), lambda x: F.regexp_replace(x, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    return F.array_distinct(F.transform(F.filter(bare, lambda x: long(x) & x.rlike("^\\p{Lu}")), lambda x: F.lower(x)))


def named_entity_overlap(query: Column, text: Column) -> Column:
    """How many of the query's named entities stand in the text."""
    low = F.lower(text)
    return F.size(F.filter(named_entities(query), lambda x: low.contains(x)))


def line_quality(c: Column) -> Column:
    """.52 letters + .28 (1 - symbols) + .20 length (up to 80 characters)."""
    return 0.52 * alpha_ratio(c) + 0.28 * (1 - symbol_ratio(c)) + 0.20 * F.least(F.lit(1.0), F.length(c) / 80.0)


def noise_score(c: Column) -> Column:
    """Share of lines that are mostly symbols or under three letters and digits."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    noisy = F.filter(lines, lambda x: (symbol_ratio(x) > 0.46) | (F.length(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", "")) < 3))
    return F.when(F.size(lines) == 0, F.lit(1.0)).otherwise(F.size(noisy) / F.size(lines))


# Patterns of structured mentions.
FILE_PATTERN = "([\\w./-]+\\.(?:rs|py|ts|tsx|js|json|md|toml|yaml|yml|sql|html|css|txt|csv|pdf))\\b"
URL_PATTERN = "(https?://[^\\s)\\]>\"']+)"
ISSUE_PATTERN = "(#\\d+|[A-Z]{2,10}-\\d+)\\b"
COMMAND_PATTERN = "(?m)^\\s*[$>]\\s+(.+)$"
EMAIL_PATTERN = "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})"


def mentions(c: Column) -> Column:
    """Files, urls, issues and commands named in a text, each as a distinct list."""
    pick = lambda p: F.array_distinct(F.regexp_extract_all(c, F.lit(p)))
    return F.struct(pick(FILE_PATTERN).alias("files"), pick(URL_PATTERN).alias("urls"), pick(ISSUE_PATTERN).alias("issues"), pick(COMMAND_PATTERN).alias("commands"))


def scrub(c: Column) -> Column:
    """Home folders become ~, e-mail addresses <email>, tokens of 24 or more characters <token>, in this order."""
    c = F.regexp_replace(c, "(/Users/|/home/)[^/\\s]+", "~")
    c = F.regexp_replace(c, EMAIL_PATTERN, "<email>")
    return F.regexp_replace(c, "[A-Za-z0-9_-]{24,}", "<token>")


def json_dump_like(c: Column) -> Column:
    return ((F.length(c) - F.length(F.translate(c, "{}[]\"", ""))) / F.greatest(F.length(c), F.lit(1))) > 0.12


def file_inventory_like(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(FILE_PATTERN))) >= 5
