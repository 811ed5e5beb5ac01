"""Predicates and row classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as L

# Word lists of the gates.
PASSWORD_MANAGERS = ["1password", "bitwarden", "keychain", "lastpass", "dashlane", "keepass"]
BANKING = ["chase.com", "bankofamerica", "wellsfargo", "citibank", "capitalone", "usbank", "fidelity", "vanguard", "schwab", "americanexpress", "discover.com", "paypal.com", "venmo.com", "robinhood.com"]
MEDICAL = ["epic.com", "mychart", "healthportal", "patientportal"]
AUTH = ["sign in", "log in", "login", "authenticate", "authorization", "oauth", "saml", "two-factor", "2fa"]
SECRETS = ["api_key", "apikey", "secret_key", "private_key", "access_token", "password:", "passwd:", "token:", "-----begin rsa", "-----begin ec", "ghp_", "sk-", "xoxb-"]
SHARE_BLOCKED = ["password", "bank", "chase", "wellsfargo", "paypal", "venmo", "whatsapp", "imessage", "messenger", "signal", "credit card", "creditcard", "ssn", "social security"]
SHARE_LOCAL = ["salary", "compensation", "offer letter", "personal", "private"]
SEARCH_KEYS = ["q", "query", "search", "keyword", "k"]
SEARCH_SEGMENTS = ["search", "results", "find"]
FEED_SEGMENTS = ["feed", "home", "explore", "trending", "for-you", "timeline"]
LISTING_SEGMENTS = ["profile", "user", "users", "tag", "tags", "collection", "collections", "category"]


def all_of(*parts: Column | None) -> Column:
    """Conjunction of the predicates given; none: every row."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def matches(columns: list[str], term: str) -> Column:
    """Case-folded substring match in any column."""
    t = term.lower()
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t) for c in columns])


def blocked_app(app: Column, blocklist: list[str]) -> Column:
    """Substring either way, case-folded."""
    a = F.lower(F.trim(app))
    return reduce(lambda x, y: x | y, [a.contains(b.lower()) | (F.lit(b.lower()).contains(a) & (a != "")) for b in blocklist if b.strip()], F.lit(False))


def blocked_context(title: Column, url: Column, blocklist: list[str]) -> Column:
    """Title or url contains an entry, or the host is it, above it or below it."""
    t, u, h = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))), L.domain(url)
    one = lambda b: t.contains(b) | u.contains(b) | (h == b) | h.endswith("." + b) | ((h != "") & F.lit(b).endswith(F.concat(F.lit("."), h)))
    return reduce(lambda x, y: x | y, [one(b.lower()) for b in blocklist if b.strip()], F.lit(False))


# What marks the pages of a bank.
SENSITIVE = ["chase.com", "bankofamerica", "wellsfargo", "citibank", "capitalone", "usbank", "fidelity", "vanguard", "schwab", "americanexpress", "discover.com", "online banking", "sign in - bank", "login - bank"]


def sensitive_context(title: Column, url: Column) -> Column:
    """Title or url holds a mark of a bank's pages."""
    return X.contains_any(F.lower(F.coalesce(title, F.lit(""))), SENSITIVE) | X.contains_any(F.lower(F.coalesce(url, F.lit(""))), SENSITIVE)


def own_app(app: Column, bundle: Column, own: str) -> Column:
    """The engine's own app by name (but for its meetings) or by a part of its bundle id."""
    a, b = F.lower(F.trim(app)), F.lower(F.trim(F.coalesce(bundle, F.lit(""))))
    return (a.startswith(own) & ~a.contains("meeting")) | (b == f"com.{own}") | b.startswith(f"com.{own}.") | b.endswith(f".{own}") | b.contains(f".{own}.")


def private_row(app: Column, title: Column, url: Column, own: list[str], apps: list[str], contexts: list[str]) -> Column:
    return X.contains_any(F.lower(app), [o.lower() for o in own]) | blocked_app(app, apps) | blocked_context(title, url, contexts) | sensitive_context(title, url)


def safety_gate(app: Column, title: Column, url: Column, text: Column, blocklist: list[str] = (), own: list[str] = ()) -> Column:
    """allow, redact or skip_storage, by ordered rules."""
    a, t, u, x = (F.lower(F.coalesce(c, F.lit(""))) for c in (app, title, url, text))
    listed = [b.lower() for b in blocklist]
    skip = X.contains_any(a, listed) | X.contains_any(t, listed) | X.contains_any(u, listed) | X.contains_any(a, [o.lower() for o in own])
    skip = skip | X.contains_any(a, PASSWORD_MANAGERS) | (t.contains("private") & (t.contains("browsing") | t.contains("window"))) | t.contains("incognito")
    skip = skip | X.contains_any(u, BANKING) | X.contains_any(u, MEDICAL) | X.contains_any(t, AUTH) | X.contains_any(u, AUTH)
    return F.when(skip, "skip_storage").when(X.contains_any(x, SECRETS), "redact").otherwise("allow")


def share_class(blob: Column, blocked: Column | None = None, private_mode: bool = False) -> Column:
    b = F.lower(F.coalesce(blob, F.lit("")))
    out = F.when((blocked if blocked is not None else F.lit(False)) | X.contains_any(b, SHARE_BLOCKED), "BLOCKED")
    if private_mode:
        return out.otherwise("LOCAL_ONLY")
    return out.when(X.contains_any(b, SHARE_LOCAL), "LOCAL_ONLY").otherwise("SHARED_ANON")


def policy_gate(mode: Column, decision: Column, opted_in: Column) -> Column:
    """Only what is shared anonymously goes out: never, for members, or where the user opted in."""
    return F.coalesce((decision == "SHARED_ANON") & F.when(mode == "members", True).when(mode == "opt_in", opted_in).otherwise(False), F.lit(False))


def too_noisy(noise: Column, most: float = 0.97) -> Column:
    return noise > most


def nav_heavy(nav: Column, signal: Column) -> Column:
    """A page that is mostly navigation and has hardly any content."""
    return (nav > 0.58) & (signal < 0.18)


def surface_policy(app: Column, url: Column) -> Column:
    """normal, url_only or skip_frame; browsers only."""
    browser = X.contains_any(F.lower(app), ["chrome", "safari", "firefox", "edge", "arc", "brave", "browser"])
    seg, keys = L.path_segments(url), L.query_keys(url)
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    search = F.arrays_overlap(keys, lit(SEARCH_KEYS)) & F.arrays_overlap(seg, lit(SEARCH_SEGMENTS))
    feed = F.arrays_overlap(seg, lit(FEED_SEGMENTS))
    return F.when(~browser | F.coalesce(url, F.lit("")).eqNullSafe(""), "normal").when(search | feed, "skip_frame").when(F.arrays_overlap(seg, lit(LISTING_SEGMENTS)), "url_only").otherwise("normal")


def indexable(text: Column, least: int = 6) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{N}]+", "")) >= least


def index_url(url: Column, title: Column) -> Column:
    """Canonical url; null on sign-in hosts and pages."""
    bad = X.contains_any(L.domain(url), ["accounts.", "login.", "auth.", "signin."]) | X.contains_any(F.lower(F.coalesce(title, F.lit(""))), AUTH + ["404", "not found", "access denied"])
    return F.when(bad | (F.trim(F.coalesce(url, F.lit(""))) == ""), F.lit(None)).otherwise(L.canonical(url))


# Words of the privacy classes, first match counts.
PRIVACY = [("secret", ["password", "secret", "token"]), ("sensitive", ["bank", "finance", "health"]), ("personal", ["message", "mail"])]
DESIGN_VERBS = ["design", "designed", "propose", "proposed", "plan", "planned", "architect", "architected"]
# Fragments of urls, titles and paths that name an action, first match counts.
ACTION_RULES = [
    ("meeting", {"url": ["zoom", "meet.google"], "title": ["zoom meeting", "zoom", "meet.google"], "activity": ["meeting"]}),
    ("communication", {"url": ["mail.google", "slack.com", "discord.com"], "title": ["inbox"]}),
    ("reviewing", {"url": ["/pull/", "/merge_requests/"], "title": ["pull request", "code review"]}),
    ("coding", {"suffix": [".rs", ".ts", ".tsx", ".go", ".py"], "title": ["debug", "compiler error"]}),
    ("writing", {"url": ["notion.", "docs.google"], "title": ["design doc", "prd"]}),
    ("planning", {"url": ["linear.app", "jira"], "title": ["roadmap", "sprint planning"]}),
    ("research", {"url": ["arxiv.org", "wikipedia.org"], "title": ["research"]}),
]
ACTIVITY_ACTIONS = {"coding": "coding", "development": "coding", "browsing": "research", "reading": "research", "communication": "communication", "docs": "writing", "documentation": "writing", "design": "planning"}
# Least scores of a primary memory and the beginnings of template texts.
PRIMARY = {"specificity": 0.60, "intent": 0.55, "usefulness": 0.60, "noise": 0.50}
TEMPLATES = ["screen capture (visual)", "captured recent activity", "url-only surface capture"]
POLLUTED = ["Reopen: ", "Continues from "]


def _folded(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def privacy_class(*parts: Column) -> Column:
    """secret, sensitive, personal or project, by the words of app, title and text."""
    t, out = _folded(*parts), F.lit("project")
    for name, words in reversed(PRIVACY):
        out = F.when(X.contains_any(t, words), name).otherwise(out)
    return out


def activity_type(explicit: Column, errors: Column, commands: Column, decisions: Column, next_steps: Column, files: Column, context: Column, url: Column, text: Column) -> Column:
    """The stated activity, else by structure, else by the strongest cue in the text. errors to files are arrays; null is empty."""
    n = {k: F.greatest(F.coalesce(F.size(v), F.lit(0)), F.lit(0)) for k, v in {"err": errors, "cmd": commands, "dec": decisions, "next": next_steps, "files": files}.items()}
    design = F.exists(F.coalesce(decisions, F.array().cast("array<string>")), lambda d: F.element_at(F.split(F.lower(F.trim(d)), "\\s+"), 1).isin(DESIGN_VERBS))
    t, linked = F.lower(F.concat_ws(" ", text, context)), url.isNotNull()
    cue = lambda *words: X.contains_any(t, list(words))
    return (
        F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", F.lower(explicit))
        .when((n["err"] > 0) & (n["cmd"] > 0), "debugging")
        .when((n["dec"] >= 1) & (n["next"] >= 2), "implementation planning")
        .when((n["files"] >= 2) & (n["dec"] == 0), "refactor review")
        .when(design, "system design")
        .when((n["next"] >= 1) & linked, "architecture analysis")
        .when((F.length(F.coalesce(context, F.lit(""))) > 800) & (n["err"] == 0) & (n["cmd"] == 0), "instruction writing")
        # the cues by falling weight: .40, .32, .30, .26, .24, .20
        .when((n["err"] > 0) | cue("error", "failed"), "debugging")
        .when(n["files"] > 0, "coding")
        .when((n["dec"] > 0) | cue("decision", "tradeoff"), "planning")
        .when(cue("test", "assert", "validation"), "testing_workflow")
        .when((n["next"] > 0) | cue("todo", "next step"), "organizing_information")
        .when(linked, "researching")
        .otherwise("unknown")
    )


def action_class(url: Column, title: Column, summary: Column, activity: Column, files: Column) -> Column:
    """The first class with a fragment in url, title or activity or a file of its kind; else by the activity's name; else other."""
    fold = lambda c: F.lower(F.coalesce(c, F.lit("")))
    where = {"url": fold(url), "title": F.concat(fold(title), F.lit(" "), fold(summary)), "activity": fold(activity)}
    paths = F.coalesce(files, F.array().cast("array<string>"))
    named = F.create_map(*[F.lit(x) for kv in ACTIVITY_ACTIONS.items() for x in kv])
    out = F.coalesce(named[where["activity"]], F.lit("other"))
    for name, rule in reversed(ACTION_RULES):
        hit = F.lit(False)
        for kind, parts in rule.items():
            hit = hit | (F.exists(paths, lambda p: reduce(lambda a, b: a | b, [F.lower(p).endswith(x) for x in parts])) if kind == "suffix" else X.contains_any(where[kind], parts))  # noqa: B023
        out = F.when(hit, name).otherwise(out)
    return out


def polluted(context: Column) -> Column:
    """A line of the context begins with a machine's mark."""
    return F.exists(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: reduce(lambda a, b: a | b, [F.ltrim(x).startswith(m) for m in POLLUTED]))


def fluff(insight: Column, app: Column) -> Column:
    """A screenshot's file name, a template, or the app's name twice in four words."""
    what = F.trim(F.coalesce(insight, F.lit("")))
    low, name = F.lower(what), F.lower(F.trim(F.coalesce(app, F.lit(""))))
    shot = low.contains(".png") & (F.length(F.regexp_replace(low, "[^0-9]", "")) >= 6)
    template = reduce(lambda a, b: a | b, [low.startswith(t) for t in TEMPLATES])
    mentions = (F.length(low) - F.length(F.replace(low, name, F.lit("")))) / F.length(name)
    repeats = F.when((name != "") & (F.size(F.split(what, "\\s+")) <= 4), mentions >= 2).otherwise(False)
    return (what != "") & (shot | template | repeats)


def storage_outcome(r: dict[str, Column]) -> Column:
    """Where a record goes: hard gates first, then primary, merge, discard, enriched, low quality or deferred.

    r has visual_failed, unavailable, weak_visual and related (booleans), grounding
    (null: unknown), context, insight, app, fingerprint, specificity, intent,
    usefulness, noise, retrieval and evidence.
    """
    primary = (r["specificity"] >= PRIMARY["specificity"]) & (r["intent"] >= PRIMARY["intent"]) & (r["usefulness"] >= PRIMARY["usefulness"]) & (r["noise"] <= PRIMARY["noise"])
    return (
        F.when(r["visual_failed"], "visual_semantics_failed")
        .when(r["unavailable"] & (F.coalesce(r["grounding"], r["evidence"]) <= 0), "quarantine_low_grounding")
        .when(polluted(r["context"]), "quarantine_polluted_context")
        .when(fluff(r["insight"], r["app"]), "quarantine_fluff_insight")
        .when(r["weak_visual"], "low_quality_evidence")
        .when(primary, "primary_memory_card")
        .when((F.trim(F.coalesce(r["fingerprint"], F.lit(""))) != "") & (r["specificity"] < PRIMARY["specificity"]), "merge_into_existing_memory")
        .when(r["related"] & (r["retrieval"] < 0.35) & (r["evidence"] < 0.50), "discard_duplicate")
        .when(r["usefulness"] >= 0.45, "enriched_memory_card")
        .when(r["evidence"] >= 0.45, "low_quality_evidence")
        .otherwise("defer_until_more_context")
    )


# What a vague context says, its least words, limits of two scores, the beginning of a text that its embedding text must not have.
VAGUE, LEAST_WORDS = ["user engaged with", "low confidence", "ui elements", "window and saw", "general browsing", "some activity"], 10
LEAST_USEFULNESS, MOST_NOISE, RAW_START, RAW_LENGTH = 0.60, 0.50, 42, 60


def debug_text(c: Column) -> Column:
    """ASCII letters and digits in lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def quality_issues(df: DataFrame, expected: Column) -> DataFrame:
    """Rows with at least one issue and the list of them, in a fixed order.

    df: context, intent, project, topic, entities, files, usefulness, noise, outcome,
    weak_graph (number of graph events of weak evidence), embedding_text, text;
    ``expected`` is the outcome that storage_outcome gives the row.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    once = lambda c, rule: F.transform(F.array(debug_text(F.col(c))), rule)[0]  # the text is made once for all that is asked of it
    vague = once("context", lambda x: (x == "") | (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1 < LEAST_WORDS) | reduce(lambda a, b: a | b, [x.contains(v) for v in VAGUE]))
    starts = lambda x: once("text", lambda t: (F.substring(t, 1, RAW_START) != "") & x.startswith(F.substring(t, 1, RAW_START)))
    dominated = once("embedding_text", lambda x: F.when(F.length(x) > RAW_LENGTH, starts(x)).otherwise(False))
    flags = {
        "vague_memory_context": vague,
        "missing_intent": blank("intent"),
        "missing_project_or_topic": blank("project") & (blank("topic") | (F.col("topic") == "unknown")),
        "missing_entities": (F.size("entities") <= 0) & (F.size("files") <= 0),
        "low_agent_usefulness": F.col("usefulness") < LEAST_USEFULNESS,
        "high_ocr_noise": F.col("noise") > MOST_NOISE,
        "primary_should_be_low_quality_evidence": (F.col("outcome") == "primary_memory_card") & (expected != "primary_memory_card"),
        "graph_events_with_weak_evidence": F.col("weak_graph") > 0,
        "embedding_text_dominated_by_raw_ocr": dominated,
    }
    issues = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items()]))
    return df.withColumn("issues", issues).where(F.size("issues") > 0)


def graph_view(nodes: DataFrame, edges: DataFrame, node_filter: Column, edge_filter: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and passing edges both of whose ends are kept."""
    n = nodes.where(node_filter)
    ids = n.select("id")
    e = edges.where(edge_filter).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return n, e


def graph_mask(nodes: DataFrame, edges: DataFrame, hide: Column, drop: Column) -> tuple[DataFrame, DataFrame]:
    """Hidden nodes lose label; dropped ones go with their edges."""
    n, e = graph_view(nodes, edges, ~drop, F.lit(True))
    return n.withColumn("label", F.when(hide, F.lit("(private)")).otherwise(F.col("label"))), e


def back_filled(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add missing columns and fill null ones with their default."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})
