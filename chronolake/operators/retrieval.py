"""Hybrid retrieval: query profile, vector and keyword search, fusion, rerank, gate, diversity, verification.

A query is parsed once on the driver; everything about rows is Column expressions
over a candidate table, so a search is one plan and one action.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as L
from ..functions import vector as V

# Weights and limits.
FUSION = {"semantic": 0.44, "snippet": 0.18, "lexical": 0.38}
SHORT = {"semantic": 0.24, "snippet": 0.14, "lexical": 0.62}
LEXICAL_ONLY = {"semantic": 0.0, "snippet": 0.0, "lexical": 1.0}
FIELD_WEIGHTS = {"title": 1.8, "snippet": 1.35, "context": 1.25, "text": 1.1, "shadow": 1.05, "alias": 1.0, "url": 0.95, "app": 0.75}
RECENCY_WORDS = ["recent", "latest", "last", "today", "yesterday", "now", "current", "after", "new"]
# A route's weight, and what an intent changes in it.
BASE_WEIGHTS = {"chunk": 0.45, "vector": 0.45, "keyword": 0.20, "temporal": 0.10, "entity": 0.10, "graph": 0.10, "recency": 0.05}
WEIGHT_CHANGES = {
    "resume_work": {"chunk": 0.40, "vector": 0.35, "temporal": 0.20, "graph": 0.15},
    "debug": {"chunk": 0.40, "vector": 0.35, "graph": 0.20},
    "lookup": {"chunk": 0.40, "vector": 0.35, "keyword": 0.30},
    "how_to": {},
    "definition": {},
    "timeline": {"chunk": 0.35, "vector": 0.30, "temporal": 0.25},
    "related_to": {"chunk": 0.40, "vector": 0.35, "graph": 0.20},
}
INTENT_WEIGHTS = {intent: BASE_WEIGHTS | changes for intent, changes in WEIGHT_CHANGES.items()}
# Hops, kinds of seeds and edges of the graph route by intent.
GRAPH_PLANS = {
    "resume_work": (2, ["Project", "Session", "Memory", "Task"], ["OccurredInSession", "BelongsToProject", "PrecededBy", "FollowedBy", "SameTaskAs"]),
    "debug": (2, ["Error", "File", "Command", "Memory"], ["Causes", "Resolves", "FixedBy", "BrokeBy", "TriggeredBy"]),
    "lookup": (1, ["Memory", "Concept", "File", "Url"], ["MentionedIn", "BelongsToProject"]),
    "how_to": (1, ["Tool", "Command", "File", "Memory"], ["UsedIn", "MentionedIn", "EvidencedBy"]),
    "definition": (2, ["Concept", "Memory"], ["BelongsToProject", "MentionedIn", "EvidencedBy"]),
    "timeline": (0, ["Session", "Memory"], ["PrecededBy", "FollowedBy"]),
    "related_to": (2, ["Concept", "Memory"], ["SimilarTo", "MentionedIn"]),
}
# Parts of a question that tell its intent, first match counts.
INTENT_WORDS = [
    ("timeline", ["timeline", "chronology", "sequence of"]),
    ("resume_work", ["resume", "pick up", "continue", "working on", "left off"]),
    ("debug", ["debug", "error", "failed", "failure", "panic", "exception", "broken"]),
    ("related_to", ["related to", "similar to", "connected to"]),
]
TEMPORAL_WORDS = ["today", "yesterday", "last week", "before", "after", "recent", "latest"]
DEFINITION_STARTS = ("why is ", "why does ", "what is ", "define ")


def _norm(s: str) -> str:
    return " ".join(re.sub(r"[^\w]|_", " ", s.lower()).split())


def _stem(w: str) -> str:
    for end, least, put in (("ies", 4, "y"), ("ing", 5, ""), ("ed", 4, ""), ("es", 4, ""), ("s", 3, "")):
        if len(w) > least and w.endswith(end):
            return w[: -len(end)] + put
    return w


@dataclass
class Profile:
    """What a query asks for."""

    raw: str
    normalised: str = ""
    intent: str = "general"
    primary: list[str] = field(default_factory=list)
    expanded: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    phrase: str | None = None
    recent: bool = False

    def __post_init__(self):
        n = self.normalised = _norm(self.raw)
        words = n.split()
        self.numbers = [w for w in dict.fromkeys(words) if w.isdigit()]
        self.primary = [w for w in dict.fromkeys(words) if len(w) > 2 and w not in X.STOP_WORDS and not w.isdigit()][:8]
        self.expanded = list(dict.fromkeys(x for w in self.primary for x in (w, _stem(w), w[:-1] if w.endswith("s") and len(w) > 3 else w, w if w.endswith("s") else w + "s")))
        self.phrase = n if len(words) >= 2 else None
        self.recent = any(w in n for w in RECENCY_WORDS)
        for kind, starts in (("definition", ("what is", "what are", "define", "meaning of")), ("howto", ("how to", "how do", "how can")), ("lookup", ("find", "show", "where", "when", "who", "open"))):
            if n.startswith(starts):
                self.intent = kind
                break

    @property
    def short(self) -> bool:
        return len(self.primary) <= 2


def keyword_terms(query: str, most: int = 24) -> list[str]:
    """Phrase, tokens, prefixes of 3 and 4, the token without its middle character, its first three 3-grams."""
    n = _norm(query)
    out = [n]
    for w in n.split():
        if w in X.STOP_WORDS and not w.isdigit():
            continue
        out.append(w)
        out += [w[:k] for k in (3, 4) if len(w) > k]
        if len(w) >= 5:
            out.append(w[: len(w) // 2] + w[len(w) // 2 + 1 :])
        if len(w) >= 6:
            out += [w[i : i + 3] for i in range(3)]
    return [x for x in dict.fromkeys(out) if x][:most]


def keyword_variants(query: str, most: int = 8) -> list[str]:
    """Phrase, numbers, the first four terms together, pairs, the longest terms, single terms."""
    p = Profile(query)
    out = [p.normalised, " ".join(p.numbers), " ".join(p.primary[:4])]
    out += [" ".join(x) for x in zip(p.primary, p.primary[1:])]
    out += sorted(p.primary, key=lambda w: (-len(w), w))[:3] + p.primary
    return [x for x in dict.fromkeys(out) if x][:most]


def _any(cs) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


def _add(cs) -> Column:
    return reduce(lambda a, b: a + b, cs, F.lit(0.0))


def lexical_score(fields: dict[str, Column], terms: list[str], phrase: str | None = None) -> Column:
    """0.7 min(1, w / 2.8 n) + 0.3 coverage, w the weights of the fields that hold each term (+1.1 for the phrase in any)."""
    if not terms:
        return F.lit(0.0)
    low = {k: F.lower(F.coalesce(c, F.lit(""))) for k, c in fields.items()}
    per_term = [_add([F.when(low[k].contains(t), FIELD_WEIGHTS[k]).otherwise(0.0) for k in low]) for t in terms]
    w = _add(per_term)
    if phrase:
        w = w + F.when(_any([c.contains(phrase) for c in low.values()]), 1.1).otherwise(0.0)
    n = float(len(terms))
    hits = _add([(p > 0).cast("double") for p in per_term])
    return 0.7 * F.least(F.lit(1.0), w / (2.8 * n)) + 0.3 * hits / n


def keyword_search(df: DataFrame, query: str, fields: dict[str, str], recency: Column, limit: int | None) -> DataFrame:
    """Rows that hold any term, by .86 lexical + .14 recency; every match is scored."""
    p = Profile(query)
    terms = p.primary + p.numbers
    cols = {k: F.col(c) for k, c in fields.items()}
    found = df.where(_any([F.lower(F.coalesce(c, F.lit(""))).contains(t) for c in cols.values() for t in terms]))
    scored = found.withColumn("score", 0.86 * lexical_score(cols, terms, p.phrase) + 0.14 * recency)
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def knn(df: DataFrame, column: str, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """The k nearest rows (L2), exactly, with distance and similarity; vectors of another length take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.where(F.size(column) == len(query))
    rows = rows.where(keep) if keep is not None else rows
    d = rows.withColumn("distance", V.squared_distance(F.col(column), q))
    return d.withColumn("score", V.similarity(F.col("distance"))).orderBy("distance", "id").limit(k)


def similar_to(df: DataFrame, column: str, seed, k: int) -> DataFrame:
    """The k rows nearest to the row ``seed``, itself left out; none if it is missing or has a zero vector."""
    row = df.where(F.col("id") == seed).select(column).first()
    if row is None or not any(row[0]):
        return df.where("false").withColumn("distance", F.lit(0.0)).withColumn("score", F.lit(0.0))
    return knn(df.where(F.col("id") != seed), column, list(row[0]), k)


def chunk_hits(chunks: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Best chunk of each parent (score, then distance), joined with the parent; orphans are left out."""
    w = Window.partitionBy("parent").orderBy(F.desc("score"), "distance", "id")
    best = chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("id").alias("chunk"), "parent", "score", "distance")
    return best.join(parents, best.parent == parents.id).orderBy(F.desc("score"), "distance", "parent").limit(k)


def _stemming_to(t: str) -> list[str]:
    """The words whose stem (``X.stem``) is t."""
    def stem(w):
        for end, least, put in (("ies", 4, "y"), ("ing", 5, ""), ("ed", 4, ""), ("es", 4, ""), ("s", 3, "")):
            if len(w.encode()) > least and w.endswith(end):
                return w[: -len(end)] + put
        return w

    return [w for w in (t, t + "s", t + "es", t + "ed", t + "ing", *([t[:-1] + "ies"] if t.endswith("y") else [])) if stem(w) == t]


def _says(norm: Column, words: str) -> Column:
    """Whether a normalised text holds these neighbouring words."""
    return F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {words} ")


def _has_token(norm: Column):
    """Whether a normalised text holds a word or one of that stem, as its tokens with stems would."""
    return lambda t: _any([_says(norm, w) for w in dict.fromkeys([t, *_stemming_to(t)])])


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once, whatever reads it: filters on it are not moved before it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def coverage(p: Profile, tokens: Column) -> Column:
    """Share of primary terms among the tokens; numbers count as one more term."""
    return _coverage(p, lambda t: F.array_contains(tokens, t))


def text_coverage(p: Profile, norm: Column) -> Column:
    """``coverage`` of a normalised text's words and stems, without making them."""
    return _coverage(p, _has_token(norm))


def _coverage(p: Profile, has) -> Column:
    if not p.primary:
        return F.lit(0.0)
    hits = _add([has(t).cast("double") for t in p.primary])
    n = len(p.primary)
    if p.numbers:
        hits, n = hits + _any([has(x) for x in p.numbers]).cast("double"), n + 1
    return hits / float(n)


def phrase_alignment(p: Profile, norm: Column, pairs: Column | None = None) -> Column:
    """1 if the text holds the phrase, else the share of its word pairs that the text has (by its pairs, or looked for in the normalised text)."""
    if not p.phrase:
        return F.lit(0.0)
    w = p.phrase.split()
    own = list(dict.fromkeys(" ".join(x) for x in zip(w, w[1:])))
    share = _add([(_says(norm, x) if pairs is None else F.array_contains(pairs, x)).cast("double") for x in own]) / float(max(1, len(own)))
    return F.when(norm.contains(p.phrase), 1.0).otherwise(share)


def mentions(p: Profile, tokens: Column) -> Column:
    return _any([F.array_contains(tokens, t) for t in p.numbers + p.primary])


def with_text(df: DataFrame, text: Column) -> DataFrame:
    """Add the derived columns that scoring reads: norm, word list, tokens with stems, word pairs."""
    d = once(df, "norm", X.normalise(text)).withColumn("wordlist", F.filter(F.split("norm", " "), lambda w: w != ""))
    return d.withColumn("toks", F.array_distinct(F.concat("wordlist", F.transform("wordlist", X.stem)))).withColumn("pairs", X.bigrams(F.col("wordlist")))


def bm25(pool: DataFrame, p: Profile, name: str = "bm25") -> DataFrame:
    """BM25-like score over the pool (k1 1.2, b .75); a word counts as itself and as its stem; +.9 phrase alignment.

    The pool's size, mean length and document frequencies are one aggregate row.
    Of norm, the normalised text, only the words that count are kept; no stems are made.
    """
    norm, hits = F.col("norm"), F.col("_hits")
    wanted = {t: list(dict.fromkeys([t, *_stemming_to(t)])) for t in p.expanded}
    pool = once(pool, "_hits", F.filter(F.split("norm", " "), lambda w: w.isin([w for ws in wanted.values() for w in ws])))
    has = lambda t: F.exists(hits, lambda w: w.isin(wanted[t]))
    df_of = [F.coalesce(F.sum(has(t).cast("double")), F.lit(0.0)).alias(f"_df{i}") for i, t in enumerate(p.expanded)]
    size = F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)
    stats = pool.agg(F.count("*").cast("double").alias("_n"), F.greatest(F.lit(1.0), F.avg(size)).alias("_len"), *df_of)
    x = pool.join(F.broadcast(stats))  # one row
    length = F.greatest(size, F.lit(1)).cast("double")
    parts = []
    for i, t in enumerate(p.expanded):
        tf = F.size(F.filter(hits, lambda w: w == t)) + F.size(F.filter(hits, lambda w: w.isin(_stemming_to(t))))
        d = F.greatest(F.col(f"_df{i}"), F.lit(0.0))
        idf = F.log((F.col("_n") - d + 0.5) / (d + 0.5) + 1)
        parts.append(F.when(tf > 0, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / F.col("_len")))).otherwise(0.0))
    out = once(x, name, _add(parts) + 0.9 * phrase_alignment(p, norm))
    return out.drop("_n", "_len", "_hits", *[f"_df{i}" for i in range(len(p.expanded))])


def _ranged(c: str) -> Column:
    """Scaled to the pool's range; where all are equal, 1 if positive, else 0."""
    w = Window.partitionBy(F.lit(0))
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low > 1e-6, (F.col(c) - low) / (high - low)).otherwise(F.when(F.col(c) > 0, 1.0).otherwise(0.0))


def fuse(branches: dict[str, DataFrame], rows: DataFrame, text: str, p: Profile, limit: int | None = None) -> DataFrame:
    """Fuse branches (chunk, semantic, snippet, keyword: id, score) into one score for each id.

    The pool is the union of the branches' limited results, so its windows are small.
    """
    kinds = ("chunk", "semantic", "snippet", "keyword")
    union = reduce(lambda a, b: a.unionByName(b), [b.select("id", F.lit(k).alias("branch"), "score") for k, b in branches.items()])
    best = union.groupBy("id").agg(*[F.max(F.when(F.col("branch") == k, F.col("score"))).alias(f"by_{k}") for k in kinds])
    pool = bm25(with_text(best.join(rows, "id"), F.col(text)), p)
    pool = pool.withColumn("cover", coverage(p, F.col("toks"))).withColumn("phrase", phrase_alignment(p, F.col("norm"), F.col("pairs")))
    pool = pool.withColumn("lexical", F.col("bm25") + 0.55 * F.coalesce("by_keyword", F.lit(0.0)))
    for k in ("chunk", "semantic", "snippet"):
        pool = pool.withColumn(f"_{k}", F.coalesce(f"by_{k}", F.lit(0.0)))
    semantic = any(k in branches for k in ("chunk", "semantic", "snippet"))
    w = LEXICAL_ONLY if not semantic else SHORT if p.short else FUSION
    score = F.greatest(_ranged("_semantic"), _ranged("_chunk")) * w["semantic"] + _ranged("_snippet") * w["snippet"] + _ranged("lexical") * w["lexical"] + 0.12 * F.col("cover") + 0.08 * F.col("phrase")
    score = score * F.when(F.col("by_keyword").isNull() & (F.col("cover") < 0.16) & (F.col("phrase") < 0.10), 0.72).otherwise(1.0)
    score = score + F.when((F.col("by_semantic").isNotNull() | F.col("by_chunk").isNotNull()) & F.col("by_keyword").isNotNull(), 0.05).otherwise(0.0)
    score = score + F.when(F.col("by_chunk").isNotNull(), 0.04).otherwise(0.0)
    if p.intent == "definition":
        score = score + F.when(mentions(p, F.col("toks")), 0.04).otherwise(0.0)
    out = pool.withColumn("score", score).drop("_chunk", "_semantic", "_snippet")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def signal_strength(confidence: Column, noise: Column, source: Column, snippet_words: Column, text_words: Column) -> Column:
    s = F.lower(F.trim(source))
    weight = F.when(s == "llm", 1.0).when(s.isin("vlm", "vision_mtmd"), 0.9).when(s == "vision_fallback", 0.72).when(s == "fallback", 0.66).otherwise(0.58)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return clamp(0.24 * clamp(confidence) + 0.28 * (1 - clamp(noise)) + 0.18 * weight + 0.16 * F.least(snippet_words, F.lit(24)) / 24.0 + 0.14 * F.least(text_words, F.lit(80)) / 80.0)


def retention_days(signal: Column) -> Column:
    return 14 + 46 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), signal))


def staleness(age_days: Column, signal: Column, fresh: bool) -> Column:
    keep = retention_days(signal)
    over = F.greatest(F.lit(0.0), F.least(F.lit(1.5), (age_days - keep) / keep))
    penalty = F.greatest(F.lit(0.12), 1 - 0.78 * over) if fresh else F.greatest(F.lit(0.58), 1 - 0.30 * over)
    return F.when(age_days > keep, penalty).otherwise(1.0)


def source_alignment(p: Profile, title: Column, app: Column, url: Column, body: Column) -> Column:
    """1.0 for app or domain, .85 for title or url, .45 for the body, 0 otherwise."""
    has = lambda c: _any([F.lower(F.coalesce(c, F.lit(""))).contains(t) for t in p.primary])
    return F.when(has(app) | has(L.domain(url)), 1.0).when(has(title) | has(url), 0.85).when(has(body), 0.45).otherwise(0.0)


# What marks a browser's own text; factors for it, for a term in the domain, and for categories and aliases that match (each, at most).
CHROME_TITLE, CHROME_TEXT = "new tab", ["new tab", "tab strip", "back forward", "home trending", "notifications"]
CHROME, DOMAIN_TERM, CATEGORY, ALIAS = 0.62, 1.08, (0.12, 0.30), (0.08, 0.20)


def name_factors(p: Profile, norm: Column, title: Column, url: Column, categories: Column | None = None, aliases: Column | None = None) -> list[Column]:
    """Factors of a reranked row for browser text, a term in its domain, and categories and aliases that the query names."""
    site = L.domain(F.coalesce(url, F.lit("")))
    chrome = (X.normalise(F.coalesce(title, F.lit(""))) == CHROME_TITLE) | X.contains_any(norm, CHROME_TEXT)
    out = [F.when(chrome, CHROME).otherwise(1.0), F.when((site != "") & _any([site.contains(t) for t in p.primary]), DOMAIN_TERM).otherwise(1.0)]
    for names, least, (each, most) in ((categories, 0, CATEGORY), (aliases, 2, ALIAS)):
        if names is not None:
            met = lambda x: (F.octet_length(x) >= least) & (_any([x.contains(t) for t in p.primary]) | F.lit(p.raw.lower()).contains(x))  # noqa: E731, B023
            n = F.size(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.lower(x)), met))
            out.append(1 + F.least(n * each, F.lit(most)))
    return out


def rerank(pool: DataFrame, p: Profile, age_hours: Column, require_anchor: bool | None = None) -> DataFrame:
    """Multiply the score by the row's relevance, age, quality and source factors.

    pool has score, norm, toks, pairs, wordlist, title, app, url, snippet, session,
    us, confidence, noise, source and decay, and may have categories and aliases (arrays).
    """
    c = F.col
    anchor = len(p.primary) <= 2 if require_anchor is None else require_anchor
    cover, phrase = coverage(p, c("toks")), phrase_alignment(p, c("norm"), c("pairs"))
    says = mentions(p, c("toks"))
    relevance = F.least(F.lit(1.0), 0.58 * cover + 0.28 * phrase + 0.14 * says.cast("double"))
    h = F.least(age_hours, F.lit(720.0))
    every = Window.partitionBy(F.lit(0))
    fresh = (c("us") - F.min("us").over(every)) / F.greatest(F.max("us").over(every) - F.min("us").over(every), F.lit(1))
    together = F.count("*").over(Window.partitionBy("session"))
    align = source_alignment(p, c("title"), c("app"), c("url"), c("norm"))
    signal = signal_strength(c("confidence"), c("noise"), c("source"), F.size(X.words(c("snippet"))), F.size("wordlist"))
    named = F.size(F.array_intersect(X.named_entities(c("snippet")), F.array(*[F.lit(x) for x in p.primary]).cast("array<string>")))
    when = lambda cond, v: F.when(cond, v).otherwise(1.0)
    factors = [
        0.70 + 0.58 * relevance,
        1 / (1 + h * (0.0048 if p.recent else 0.0012)),
        (1 + 0.28 * fresh) if p.recent else F.lit(1.0),
        when(F.lower(F.trim(c("title"))).isin("", "untitled", "new tab", "home"), 0.72),
        when(c("confidence") > 0, 0.75 + 0.35 * F.least(c("confidence"), F.lit(1.0))),
        when(c("noise") > 0, F.greatest(F.lit(0.45), 1 - 0.35 * c("noise"))),
        when(X.symbol_ratio(c("norm")) > 0.46, 0.7),
        when(F.size(X.words(c("snippet"))) < 4, 0.82),
        when(X.file_inventory_like(c("norm")) | X.json_dump_like(c("norm")), 0.55),
        F.when(cover > 0, 1 + 0.28 * F.least(cover, F.lit(0.85))).otherwise(0.68 if p.primary else 1.0),
        when(~says, 0.22) if anchor and p.primary else F.lit(1.0),
        0.72 + 0.48 * align,
        when(align < 0.30, 0.68) if len(p.primary) == 1 else F.lit(1.0),
        1 + F.least(0.06 * named, F.lit(0.18)),
        when(~says, 0.5) if p.numbers else F.lit(1.0),
        when((L.domain(c("url")) != "") & F.lit(p.normalised).contains(L.domain(c("url"))), 1.18),
        when(F.lit(p.normalised).contains(X.normalise(c("app"))) & (X.normalise(c("app")) != ""), 1.16),
        when(F.lower(c("source")) == "llm", 1.05),
        when(together > 1, 1 + F.least(0.04 * together, F.lit(0.16))),
        0.78 + 0.32 * signal,
        staleness(age_hours / 24, signal, p.recent),
        F.greatest(c("decay"), F.lit(0.15)),
        *name_factors(p, c("norm"), c("title"), c("url"), *[c(x) if x in pool.columns else None for x in ("categories", "aliases")]),
    ]
    return pool.withColumns({"score": reduce(lambda a, b: a * b, factors, c("score")), "signal": signal})


# Terms too weak to anchor a query; least coverage by number of primary terms; floors of the gate and of the diversity, top rows that keep their places.
WEAK_TERMS = "last time times first recent latest watch watched watching find found show showed showing look looked open opened".split()
LEAST_COVERAGE = {4: 0.30, 3: 0.24, 2: 0.17, 1: 0.18}
ABSOLUTE_FLOOR, MANY_TERMS, DEFINITION, RELATIVE_FLOOR = 0.24, 0.04, 0.02, 0.32
STRONG_FLOOR, MEDIUM_FLOOR, LATER_SHARE, TOP_SHARE, KEPT_TOP, EARLY = 0.70, 0.60, 0.9, 0.42, 3, 8
# Likeness of two texts that are one, rows of a session, results of the deduplication.
ALIKE, OF_SESSION, RESULTS = 0.92, 2, (6, 30)
# What a first and each further row of an app, a source and half an hour adds; the share of the signal strength.
DIVERSITY = {"app": (0.10, 0.10), "place": (0.07, 0.08), "slot": (0.04, 0.03)}
RECENT_SLOT, SIGNAL_SHARE, SLOT_US = 0.02, 0.04, 1_800_000_000


def anchor_terms(p: Profile) -> list[str]:
    """Primary terms of four bytes or more that are not weak; else the first one."""
    return [t for t in p.primary if len(t.encode()) >= 4 and t not in WEAK_TERMS] or p.primary[:1]


def anchor_required(p: Profile) -> bool:
    """Short questions need an anchor, and those of which at most half the terms are anchors."""
    found = anchor_terms(p)
    return bool(found) and ((len(p.primary) <= 2 and p.intent == "general") or len(found) <= max(1, len(p.primary) // 2))


def has_anchor(p: Profile, tokens: Column) -> Column:
    """A number of the query, or an anchor or its stem, is among the tokens."""
    return _any([F.array_contains(tokens, t) for t in [*p.numbers, *dict.fromkeys(x for t in anchor_terms(p) for x in (t, _stem(t)))]])


def relevance_gate(pool: DataFrame, p: Profile, now_us: Column | None = None) -> DataFrame:
    """Keep the rows of a pool that pass all gates.

    Score: at least .24 (.04 more from four primary terms, .02 for definitions), but
    never over .9 of the best; at least .32 of the best, for all but the first that
    passes. Coverage: .18, .17, .24, .30 for one, two, three, four terms, or the row
    holds a term or number. An anchor where one is required; a number where one is
    asked for; for questions of freshness (``now_us`` given) not older than its signal
    keeps it. pool: id, score, toks, us and, for freshness, signal.
    """
    floor = ABSOLUTE_FLOOR + (MANY_TERMS if len(p.primary) >= 4 else 0.0) + (DEFINITION if p.intent == "definition" else 0.0)
    says = mentions(p, F.col("toks"))
    keep = F.col("score") >= F.least(F.lit(floor), F.greatest(F.col("_top") * 0.90, F.lit(0.01)))
    if p.primary:
        keep = keep & ((coverage(p, F.col("toks")) >= LEAST_COVERAGE[min(4, len(p.primary))]) | says)
    if anchor_required(p):
        keep = keep & has_anchor(p, F.col("toks"))
    if p.numbers:
        keep = keep & says
    if now_us is not None and p.recent:
        keep = keep & (F.greatest(now_us - F.col("us"), F.lit(0)) / 86_400_000_000 <= retention_days(F.col("signal")))
    best = pool.agg(F.max("score").alias("_top"))
    passed = pool.join(F.broadcast(best)).where(keep)  # one row
    first = passed.agg(F.max_by("id", F.struct("score", "us")).alias("_first"))
    return passed.join(F.broadcast(first)).where((F.col("score") >= F.col("_top") * RELATIVE_FLOOR) | (F.col("id") == F.col("_first"))).drop("_top", "_first")  # one row


def fuzzy_dedup(rows: list[dict], limit: int) -> list[dict]:
    """Of rows in order of score, those whose words are not .92 alike with a row before and that are among the first two of their session; at most 6 to 30."""
    kept, sessions = [], {}
    for r in rows:
        own = set(r["toks"])
        if not own or any(len(own & x) >= ALIKE * len(own | x) for x in (set(k["toks"]) for k in kept)) or sessions.get(r["session"], 0) >= OF_SESSION:
            continue
        sessions[r["session"]] = sessions.get(r["session"], 0) + 1
        kept.append(r)
        if len(kept) >= min(max(limit, RESULTS[0]), RESULTS[1]):
            break
    return kept


def diverse(rows: list[dict], limit: int, recent: bool = False) -> list[dict]:
    """Greedy selection for diversity of app, place (domain or session) and half hour; the first three keep their places."""
    rows, desired = list(rows), min(limit, 30)
    top = rows[0]["score"] if rows else 0.0
    strong, medium = min(STRONG_FLOOR, top), min(MEDIUM_FLOOR, top)
    selected, seen = rows[: min(KEPT_TOP, desired)], {}
    rows = rows[len(selected) :]
    keys = lambda r: [("app", r["app"]), ("place", r["place"]), ("slot", r["us"] // SLOT_US)]
    for r in selected:
        for k in keys(r):
            seen[k] = seen.get(k, 0) + 1

    def worth(r):
        out = r["score"] + SIGNAL_SHARE * r["signal"]
        for k in keys(r):
            first, more = DIVERSITY[k[0]]
            n = seen.get(k, 0)
            out += (RECENT_SLOT if k[0] == "slot" and recent else first) if n == 0 else -n * more
        return out

    while len(selected) < desired and rows:
        floor = medium if len(selected) < min(EARLY, desired) else max(medium * LATER_SHARE, top * TOP_SHARE)
        fit = [i for i, r in enumerate(rows) if r["score"] >= floor]
        if not fit:
            break
        best = max(fit, key=lambda i: (worth(rows[i]), i))
        selected.append(rows.pop(best))
        for k in keys(selected[-1]):
            seen[k] = seen.get(k, 0) + 1
    for r in rows:
        if len(selected) < desired and (r["score"] >= strong or not selected):
            selected.append(r)
    return selected


def diversify(pool: DataFrame, limit: int, recent: bool = False, most: int = 64, dedup: bool = True) -> DataFrame:
    """id, place and score of the final selection out of a ranked pool of at most ``most`` rows: near copies and third rows of a session go, then rows are taken by score and diversity.

    pool: id, score, app, us, toks and, where it has them, session, url and signal.
    One pandas call over the bounded pool.
    """
    has = set(pool.columns)
    session = F.coalesce(F.col("session").cast("string"), F.lit("")) if "session" in has else F.col("id").cast("string")
    site = L.domain(F.col("url")) if "url" in has else F.lit("")
    place = F.when(F.coalesce(site, F.lit("")) == "", session).otherwise(F.concat_ws(":", F.lower("app"), site))
    cols = ["id", "score", F.lower("app").alias("app"), "us", "toks", session.alias("session"), place.alias("place"), (F.col("signal") if "signal" in has else F.lit(0.0)).alias("signal")]
    top = pool.orderBy(F.desc("score"), F.desc("us"), "id").limit(most).select(*cols)
    kind = dict(pool.dtypes)["id"]

    def f(pdf):
        import pandas as pd

        rows = pdf.sort_values(["score", "us", "id"], ascending=[False, False, True]).to_dict("records")
        kept = diverse(fuzzy_dedup(rows, limit) if dedup else rows, limit, recent)
        return pd.DataFrame({"id": [k["id"] for k in kept], "place": range(1, len(kept) + 1), "score": [k["score"] for k in kept]})

    return top.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda key, pdf: f(pdf), f"id {kind}, place long, score double")


def route_fusion(hits: DataFrame, weights: dict[str, float], cap: int = 50) -> DataFrame:
    """id, score (sum over every hit of its route's weight), the routes and the best score of each; the first ``cap``. hits: id, route, score."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))) * F.coalesce(w[F.col("route")], F.lit(0.0))
    g = hits.groupBy("id").agg(F.sum(s).alias("score"), F.max("score").alias("best"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))
    return g.orderBy(F.desc("score"), "id").limit(cap)


def temporal_route(df: DataFrame, age_hours: Column, half_life_hours: float, limit: int) -> DataFrame:
    return df.withColumn("score", F.pow(F.lit(2.0), -age_hours / half_life_hours)).orderBy(F.desc("score"), "id").limit(limit)


def entity_route(nodes: DataFrame, hints: list[str], type_weights: dict[str, float]) -> DataFrame:
    """id, score of nodes whose label equals a hint (1.0) or either begins the other (.82), by type weight and confidence."""
    label = X.normalise(F.col("label"))
    match = F.lit(0.0)
    for h in map(_norm, hints):
        match = F.greatest(match, F.when(label == h, 1.0).when((label != "") & (label.startswith(h) | F.lit(h).startswith(label)), 0.82).otherwise(0.0))
    w = F.create_map(*[F.lit(x) for kv in type_weights.items() for x in kv])
    return nodes.withColumn("score", match * F.coalesce(w[F.col("kind")], F.lit(0.8)) * F.col("confidence")).where("score > 0").select("id", "score")


def graph_route(seeds: DataFrame, reached: DataFrame) -> DataFrame:
    """.58 seed score + .42 path confidence, best per id. seeds: id, score; reached: seed, id, path_confidence."""
    x = reached.join(seeds.select(F.col("id").alias("seed"), "score"), "seed")
    return x.groupBy("id").agg(F.max(0.58 * F.col("score") + 0.42 * F.col("path_confidence")).alias("score"))


def verify(fused: DataFrame, needed: dict, evidence: dict) -> DataFrame:
    """One row: status (grounded, partial or not_enough_evidence), what is missing, and the confidence of a grounded answer.

    fused: id, score, coverage, routes (array), path_nodes (of the graph path, or null).
    needed and evidence tell which of files, decisions and errors are asked for and found.
    """
    score = F.least(F.col("score"), F.lit(1.0))
    kept = F.array_contains("routes", "graph") | (F.greatest(F.col("coverage"), score) >= 0.3)
    weak = kept & (F.col("routes") == F.array(F.lit("graph"))) & F.coalesce(F.col("path_nodes") == 2, F.lit(False))
    all_of = fused.agg(F.count("*").alias("rows"), F.count_if(kept).alias("kept"), F.countDistinct(F.when(kept, F.col("id"))).alias("backers"), F.count_if(weak).alias("weak"), F.max(F.when(kept, score)).alias("top"))
    lacks = lambda k: bool(needed.get(k)) and not evidence.get(k)
    absent = [f"no {k[:-1]} evidence" for k in ("decisions", "errors") if lacks(k)]
    confidence = F.least(F.lit(1.0), F.col("top") * 0.8 + F.least(F.col("kept"), F.lit(5)) * 0.04) * F.when(F.col("weak") > 0, 0.85).otherwise(1.0)
    few, lone = (F.col("rows") == 0) | (F.col("kept") == 0), F.col("backers") < 2
    missing = F.when(F.col("rows") == 0, "no fused hits").when(F.col("kept") == 0, "all hits below confidence threshold").when(lone, "only one memory backs the top result")
    missing = missing.otherwise("no file evidence for a file-seeking query" if lacks("files") else "; ".join(absent))
    return all_of.select(F.when(few, "not_enough_evidence").when(missing != "", "partial").otherwise("grounded").alias("status"), missing.alias("missing"), F.when(missing == "", confidence).alias("confidence"))


def token_budget(df: DataFrame, text: str, order: list, budget: int) -> DataFrame:
    """Rows in order while their running length fits 4 characters a token."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget * 4)


def merge_score(lexical: Column, vector: Column, same_domain: Column, anchor: Column) -> Column:
    return 0.5 * vector + 0.42 * lexical + 0.08 * same_domain.cast("double") + 0.32 * anchor.cast("double")


def merge_allowed(score: Column, lexical: Column, vector: Column, anchor: Column) -> Column:
    """With an anchor by its own limits only; else by words or by vector."""
    return F.when(anchor, (score >= 0.58) & (lexical >= 0.18)).otherwise(((lexical >= 0.72) & (score >= 0.80)) | ((score >= 0.86) & (vector >= 0.82) & (lexical >= 0.28)))


def merge_allowed_by_words(score: Column, lexical: Column, anchor: Column) -> Column:
    """The limits where no vector is at hand."""
    return F.when(anchor, (lexical >= 0.24) & (score >= 0.46)).otherwise((lexical >= 0.66) & (score >= 0.74))


def cross_app_merge(apart_us: Column, url: Column, other: Column, lexical: Column, vector: Column, anchor: Column) -> Column:
    """Within 45 minutes: one page, or one domain and alike by anchor and words, or by vector and words."""
    alike = (anchor & (lexical >= 0.52)) | ((vector >= 0.93) & (lexical >= 0.70))
    site = (L.domain(url) == L.domain(other)) & (L.domain(url) != "")
    return F.coalesce((F.abs(apart_us) <= 45 * 60 * 1_000_000) & ((L.page_key(url) == L.page_key(other)) | (site & alike)), F.lit(False))


def relevant(p: Profile, *texts: Column) -> Column:
    """Any expanded term of the query, of two characters or more, stands in the normalised texts."""
    text = X.normalise(F.concat_ws(" ", *texts))
    return (text != "") & X.contains_any(text, [_norm(t) for t in p.expanded if len(t) > 1])


def provenance(df: DataFrame, state: str, score: str) -> DataFrame:
    return df.withColumn(score, F.col(score) * V.provenance_factor(F.col(state)))


def planner_intent(p: Profile) -> str:
    """One of seven intents, by ordered rules over the normalised question."""
    for intent, parts in INTENT_WORDS:
        if any(x in p.normalised for x in parts):
            return intent
    if p.normalised.startswith(DEFINITION_STARTS) or p.intent == "definition":
        return "definition"
    return "how_to" if p.intent == "howto" else "lookup"


def planner_intents(question: Column) -> Column:
    """planner_intent of a column of questions."""
    n = X.normalise(F.coalesce(question, F.lit("")))
    starts = lambda words: _any([n.startswith(w) for w in words])
    out = F.when(F.lit(False), F.lit(""))
    for intent, parts in INTENT_WORDS:
        out = out.when(X.contains_any(n, parts), intent)
    return out.when(starts([*DEFINITION_STARTS, "what is", "what are", "define", "meaning of"]), "definition").when(starts(["how to", "how do", "how can"]), "how_to").otherwise("lookup")


def plan(query: str, project: str | None = None) -> dict:
    """The query plan: intent, routes, weights, hops, kinds of seeds, edges, window, entity hints and needed context."""
    p = Profile(query)
    n = p.normalised
    intent = planner_intent(p)
    hops, seeds, edges = GRAPH_PLANS[intent]
    if project and "Project" not in seeds:
        seeds = [*seeds, "Project"]
    span = "24h" if "today" in n else "yesterday" if "yesterday" in n else "7d" if "week" in n else None
    hints = re.findall(r"\b[A-Z][\w-]{2,}|\b[\w./-]+\.(?:rs|py|ts|md)\b|#\d+", query)
    routes = ["chunk", "vector", "keyword", *(["entity"] if hints or project else []), *(["temporal"] if span or p.recent or any(w in n for w in TEMPORAL_WORDS) else []), "graph"]
    has = lambda *parts: any(x in n for x in parts)
    needed = {
        "files": has("file", "path") or any("." in h for h in hints),
        "decisions": has("decision", "decided", "why"),
        "errors": intent == "debug" or has("error", "failed", "failure", "panic"),
        "todos": has("todo", "task", "next step"),
        "commands": has("command", "terminal", "run"),
        "recent_changes": intent == "resume_work" or has("recent", "latest", "changes", "working on"),
    }
    return {"profile": p, "intent": intent, "routes": routes, "weights": INTENT_WEIGHTS[intent], "hops": hops, "seeds": seeds, "edges": edges, "window": span, "hints": hints, "project": project, "needed": needed}


def refined(base: dict, changes: dict) -> dict:
    """The plan with the fields that a refinement gives; hops stay at most 2."""
    out = base | {k: v for k, v in changes.items() if v is not None and k in base}
    return out | {"hops": min(2, out["hops"])}
