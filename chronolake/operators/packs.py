"""Context packs under a token budget, project contexts, the decision ledger and change deltas for subscribers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

# A section's share of the pack's characters and its least characters; how its fields are cut: title, then body and second body also by what is left.
SECTIONS = {
    "failures": (0.20, 120, (72, 120, None)), "files": (0.20, 120, (None, 96, None)), "decisions": (0.20, 120, (80, 120, None)), "tasks": (0.10, 80, (None, 96, None)), "evidence": (0.15, 120, (None, 80, 120)),
}
# Sections that give rows back when a pack is too long, in this order; bounds of a budget; newest events and decisions of a project.
GIVES_BACK, BUDGET, PROJECT_EVENTS, PROJECT_DECISIONS = ["evidence", "decisions", "issues", "tasks"], (600, 12_000), 18, 6
# Newest events of a delta, and the characters of an event's summary in it.
DELTA_EVENTS, DELTA_SUMMARY = 24, 96


def budget_of(asked: Column) -> Column:
    return F.least(F.greatest(asked, F.lit(BUDGET[0])), F.lit(BUDGET[1]))


def _cut(c: Column, n: Column) -> Column:
    """At most n characters; a cut text ends in three dots."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, F.lit(1), F.greatest(F.lit(0), n - 3)), F.lit("...")))


def cut_sections(items: DataFrame) -> DataFrame:
    """Items cut to their section's characters, those after its end left out.

    items: pack, budget (tokens), section, rank, fixed, title, body, more (strings;
    null counts as empty). In each section an item's fields are cut to their limits
    and to what the items before it left; its length in bytes is taken off. Sections
    without a share (issues) stay. A section is one fold over its own few items.
    """
    share = lambda k: F.create_map(*[F.lit(x) for s, v in SECTIONS.items() for x in (s, v[k])])[F.col("section")]
    limit = lambda k: F.create_map(*[F.lit(x) for s, v in SECTIONS.items() if v[2][k] for x in (s, v[2][k])])[F.col("section")]
    whole = items.select("pack", "budget", "section", F.struct("rank", *[F.coalesce(c, F.lit("")).alias(c) for c in ("fixed", "title", "body", "more")]).alias("i"))
    lists = whole.groupBy("pack", "budget", "section").agg(F.array_sort(F.collect_list("i")).alias("items"))
    room = F.greatest(F.floor(F.col("budget") * 4 * share(0) + 1e-6).cast("int"), share(1))
    lists = lists.withColumns({"room": room, "c0": limit(0), "c1": limit(1), "c2": limit(2)})

    def step(acc, i):
        left = acc["left"]
        title = F.when(F.col("c0").isNull(), i["title"]).otherwise(_cut(i["title"], F.col("c0")))
        by = lambda x, c: F.when(c.isNull(), x).otherwise(_cut(x, F.least(left, c)))
        made = F.struct(i["rank"].alias("rank"), i["fixed"].alias("fixed"), title.alias("title"), by(i["body"], F.col("c1")).alias("body"), by(i["more"], F.col("c2")).alias("more"))
        size = lambda m: sum((F.octet_length(m[c]) for c in ("fixed", "title", "body", "more")), F.lit(0))
        kept = F.transform(F.array(made), lambda m: F.struct(F.greatest(F.lit(0), left - size(m)).alias("left"), F.concat(acc["kept"], F.array(m)).alias("kept")))[0]
        return F.when(left == 0, acc).otherwise(kept)

    zero = F.struct(F.col("room").alias("left"), F.slice("items", 1, 0).alias("kept"))
    kept = F.when(F.col("room").isNull(), F.col("items")).otherwise(F.aggregate("items", zero, step)["kept"])
    return lists.select("pack", "budget", "section", F.explode(kept).alias("i")).select("pack", "budget", "section", "i.*")


def give_back(items: DataFrame, base: DataFrame) -> DataFrame:
    """Items that stay when packs that are too long give rows back, with tokens, what each pack comes to.

    The last evidence goes first, then decisions, issues and tasks, each from its
    end, as long as the pack is over its budget; other sections stay. A token is four
    characters, rounded up. items: pack, budget, section, rank, chars; base: pack,
    chars (what the pack has besides items). One running sum for a pack, not a loop.
    """
    turn = F.create_map(*[F.lit(x) for k, s in enumerate(GIVES_BACK) for x in (s, k)])[F.col("section")]
    rows = items.withColumn("_turn", turn)
    total = rows.groupBy("pack").agg(F.sum("chars").alias("_items")).join(base.select("pack", F.col("chars").alias("_base")), "pack", "left")
    total = total.select("pack", (F.col("_items") + F.coalesce("_base", F.lit(0))).alias("_all"))
    w = Window.partitionBy("pack").orderBy("_turn", F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    free = rows.where("_turn is not null").withColumn("_gone", F.coalesce(F.sum("chars").over(w), F.lit(0)))
    rows = free.unionByName(rows.where("_turn is null").withColumn("_gone", F.lit(0).cast("long"))).join(total, "pack")
    goes = F.col("_turn").isNotNull() & (F.ceil((F.col("_all") - F.col("_gone")) / 4) > F.col("budget"))
    kept = rows.withColumn("_goes", goes)
    after = kept.groupBy("pack").agg(F.ceil((F.first("_all") - F.sum(F.when(F.col("_goes"), F.col("chars")).otherwise(0))) / 4).alias("tokens"))
    return kept.where("not _goes").join(after, "pack").select(*items.columns, "tokens")


def project_contexts(events: DataFrame, projects: DataFrame) -> DataFrame:
    """The context of each project (project) from its 18 newest events.

    events: id, us, project, title, summary, decisions, files, next_steps, confidence.
    goal: the first next step of the newest event that has one; decisions: the six
    newest, one for each key; files by how many events touched them, then by name;
    confidence: the mean.
    """
    w = Window.partitionBy("project").orderBy(F.desc("us"), "id")
    own = events.join(projects.select("project").distinct(), "project", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PROJECT_EVENTS)
    first = F.min_by(F.get("next_steps", F.lit(0)), F.when(F.size("next_steps") > 0, F.col("_n")))
    heads = own.groupBy("project").agg(F.count("*").alias("n"), F.max("us").alias("last_us"), F.round(F.avg("confidence"), 6).alias("confidence"), first.alias("_goal"))
    name = F.col("project")
    heads = heads.withColumns({"goal": F.coalesce("_goal", F.concat(F.lit("Continue recent "), name, F.lit(" work."))), "summary": F.concat(F.lit("Recent "), name, F.lit(" working state compiled from "), F.col("n").cast("string"), F.lit(" activity event(s)."))}).drop("_goal")
    made = own.select("project", "us", "_n", F.posexplode("decisions").alias("_p", "d")).withColumn("key", X.alias_key(F.col("d")))
    made = made.groupBy("project", "key").agg(F.min(F.struct("_n", "_p", "d")).alias("m")).select("project", F.struct("m._n", "m._p", F.concat(F.lit("decision:"), "key").alias("id")).alias("m"))
    decisions = made.groupBy("project").agg(F.transform(F.slice(F.array_sort(F.collect_list("m")), 1, PROJECT_DECISIONS), lambda x: x["id"]).alias("decisions"))
    touched = own.select("project", F.explode("files").alias("f")).groupBy("project", "f").agg((-F.count("*")).alias("k"))
    files = touched.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda x: F.concat(x["f"], F.lit(" x"), (-x["k"]).cast("string"))).alias("files"))
    none = F.array().cast("array<string>")
    return heads.join(decisions, "project", "left").join(files, "project", "left").withColumns({c: F.coalesce(c, none) for c in ("decisions", "files")})


class Ledger:
    """Decisions, appended by numbered batches, and the contexts of the projects that they touch.

    A batch's folder is written again as a whole if the batch is repeated; nothing of
    other batches is read or written for it. A project's context is that of the last
    batch that touched it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, no: int, proposals: DataFrame, memories: DataFrame, events: DataFrame) -> None:
        """proposals: id, project, title, summary, by, evidence (ids). A blank title is no decision; evidence that is not in memories (id) is left out; a blank author is 'agent'."""
        rows = proposals.where(F.trim(F.coalesce("title", F.lit(""))) != "")
        found = rows.select("id", F.explode("evidence").alias("e")).join(memories.select(F.col("id").alias("e")).distinct(), "e", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
        by = F.trim(F.coalesce("by", F.lit("")))
        entries = rows.drop("evidence").join(found, "id", "left").select("id", "project", F.trim("title").alias("title"), F.trim("summary").alias("summary"), F.when(by == "", "agent").otherwise(by).alias("by"), F.lit("proposed").alias("status"), F.coalesce("evidence", F.array().cast(found.schema["evidence"].dataType)).alias("evidence"))
        entries.write.mode("overwrite").parquet(f"{self.path}/entries/batch={no}")
        touched = self.spark.read.parquet(f"{self.path}/entries/batch={no}").where("project is not null")
        project_contexts(events, touched).write.mode("overwrite").parquet(f"{self.path}/contexts/batch={no}")

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    def contexts(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/contexts")
        return rows.groupBy("project").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("project", "batch")]), "batch").alias("m")).select("project", "m.*")


class Subscribers:
    """What changed for each subscriber since it was last told. Baselines are kept by numbered batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def baselines(self, before: int | None = None) -> DataFrame:
        """(session, baseline): the latest of each subscriber (of the batches before one, so that a repeated batch finds what it found)."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/baselines")
        except AnalysisException:  # nobody has been told anything
            return self.spark.createDataFrame([], "session string, baseline long")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy("session").agg(F.max_by("baseline", "batch").alias("baseline"))

    def deltas(self, no: int, sessions: DataFrame, events: DataFrame, now_us: int) -> DataFrame:
        """session, since, events, items, entities and failures for every session (session, since: its own start or null for its baseline).

        Only the newest 24 events of all are looked at, of which those that ended
        after the start count; so one small table meets every session. Afterwards
        each session's baseline is ``now_us``.
        """
        asked = sessions.join(self.baselines(no), "session", "left").select("session", F.coalesce("since", "baseline", F.lit(0)).alias("since"))
        newest = events.orderBy(F.desc("us"), "id").limit(DELTA_EVENTS)  # a fixed number of rows, small enough for every task
        item = F.concat_ws(": ", "title", X.trim_to(F.col("summary"), DELTA_SUMMARY))
        one = newest.agg(F.array_sort(F.collect_list(F.struct((-F.col("us")).alias("o"), "id", "us", item.alias("item"), "entities", "errors"))).alias("all"))
        rows = asked.join(F.broadcast(one)).withColumn("new", F.filter("all", lambda e: e["us"] > F.col("since")))
        distinct = lambda c: F.array_distinct(F.flatten(F.transform("new", lambda e: e[c])))
        out = rows.select("session", "since", F.transform("new", lambda e: e["id"]).alias("events"), F.transform("new", lambda e: e["item"]).alias("items"), distinct("entities").alias("entities"), distinct("errors").alias("failures"))
        at = f"{self.path}/deltas/batch={no}"
        out.write.mode("overwrite").parquet(at)
        sessions.select("session", F.lit(now_us).cast("long").alias("baseline")).write.mode("overwrite").parquet(f"{self.path}/baselines/batch={no}")
        return self.spark.read.parquet(at)
