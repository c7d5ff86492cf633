"""Statistics, listings, timelines and dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text


def memory_stats(memories: DataFrame) -> DataFrame:
    """type, importance, n, mean_importance: one pass over grouping sets (by type, by importance, all)."""
    view = memories.select("type", F.coalesce("importance", F.lit(0)).alias("importance"), F.coalesce("importance", F.lit(0)).alias("value"))
    sets = view.groupingSets([["type"], ["importance"], []], "type", "importance")
    return sets.agg(F.count(F.lit(1)).alias("n"), text.two_places(F.avg("value")).alias("mean_importance"))


def scoring_stats(scored: DataFrame) -> DataFrame:
    """For each query and chat: rows, selected, mean scores of both kinds, the top score, and the cutoff (the least selected)."""
    chosen = F.col("selected")
    return scored.groupBy("query_id", "chat_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(chosen, 1)).alias("n_selected"),
        F.greatest(F.lit(0.0), F.max("score")).alias("top_score"),
        F.min(F.when(chosen, F.col("score"))).alias("cutoff"),
        F.avg(F.when(F.col("type") == "reflection", F.col("score"))).alias("mean_reflection"),
        F.avg(F.when(F.col("type") != "reflection", F.col("score"))).alias("mean_event"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, nodes, edges: nodes of each type and the edges that leave them."""
    out = edges.join(nodes.select("chat_id", F.col("key").alias("source"), "type"), ["chat_id", "source"]).groupBy("chat_id", "type").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.groupBy("chat_id", "type").agg(F.count(F.lit(1)).alias("nodes")).join(out, ["chat_id", "type"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def strongest_nodes(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of each chat with the greatest weight of edges."""
    from . import ranking

    both = edges.select("chat_id", F.col("source").alias("key"), "weight").unionByName(edges.select("chat_id", F.col("target").alias("key"), "weight"))
    return ranking.top_n(both.groupBy("chat_id", "key").agg(F.sum("weight").alias("weight")), ["chat_id"], [F.desc("weight"), F.col("key")], n)


def most_mentioned(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of each chat that are mentioned most."""
    from . import ranking

    return ranking.top_n(nodes, ["chat_id"], [F.desc(F.coalesce("mentions", F.lit(0))), F.col("key")], n)


def characters(memories: DataFrame) -> DataFrame:
    return memories.select("chat_id", F.explode("characters").alias("character")).groupBy("chat_id", "character").agg(F.count(F.lit(1)).alias("n"))


def filter_memories(memories: DataFrame, kind: str | None = None, character: str | None = None, archived: bool | None = None) -> DataFrame:
    if kind is not None:
        memories = memories.filter(F.col("type") == kind)
    if character is not None:
        memories = memories.filter(F.array_contains("characters", character))
    if archived is not None:
        memories = memories.filter(F.coalesce("archived", F.lit(False)) == archived)
    return memories


def search(memories: DataFrame, query: str) -> DataFrame:
    """Memories whose summary, characters, location or temporal anchor contain the query, whatever the case; the columns that a table lacks don't count."""
    q = F.lower(F.lit(query))
    found = F.lit(False)
    for c in ("summary", "location", "temporal_anchor"):
        if c in memories.columns:
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return memories.filter(found | F.contains(F.lower(F.coalesce(F.array_join("characters", " "), F.lit(""))), q))


def search_nodes(nodes: DataFrame, query: str, kind: str | None = None, scope: str = "all") -> DataFrame:
    """Nodes whose name (scope name), name or alias (aliases), or any of these or description (all) contains the query, most mentioned first."""
    q = F.lower(F.lit(query))
    found = F.contains(F.lower("name"), q)
    if scope != "name":
        found = found | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), q))
    if scope == "all" and "description" in nodes.columns:
        found = found | F.contains(F.lower(F.coalesce("description", F.lit(""))), q)
    rows = nodes.filter(found)
    return (rows if kind is None else rows.filter(F.col("type") == kind)).orderBy(F.desc(F.coalesce("mentions", F.lit(0))), "ord")


def order_by(key: str = "date") -> list[Column]:
    """The order of a listing: date (newest made first), importance, or story (newest told first)."""
    if key == "importance":
        return [F.desc(F.coalesce("importance", F.lit(3))), F.col("ord")]
    return newest_first() if key == "story" else [F.desc(F.coalesce("created_at", F.lit(0))), F.col("ord")]


def story_order() -> list[Column]:
    """The order of a timeline: by the message that a memory is about; those without one come last, by the time they were made."""
    lost = F.col("message_id").isNull()
    return [lost, F.when(lost, F.coalesce("created_at", F.lit(0))).otherwise(F.col("message_id")), F.col("ord")]


def relations_of(edges: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """chat_id, key, other, name, weight, place: the neighbours of each chosen node (chat_id, key), heaviest first, then by name in Unicode order."""
    both = edges.select("chat_id", F.col("source").alias("key"), F.col("target").alias("other"), "weight").unionByName(edges.select("chat_id", F.col("target").alias("key"), F.col("source").alias("other"), "weight"))
    rows = both.join(chosen.select("chat_id", "key"), ["chat_id", "key"], "left_semi").join(nodes.select("chat_id", F.col("key").alias("other"), "name"), ["chat_id", "other"])
    order = Window.partitionBy("chat_id", "key").orderBy(F.desc("weight"), F.collate("name", "UNICODE"), "other")
    return rows.withColumn("place", F.row_number().over(order))


def character_counts(states: DataFrame) -> DataFrame:
    """chat_id, character, emotion and how many events are known, in place of the events."""
    return states.select("chat_id", "character", "emotion", F.size(F.coalesce("known_events", F.array().cast("array<string>"))).alias("known_events"))


def community_counts(communities: DataFrame) -> DataFrame:
    """chat_id, id, title and the numbers of members and findings."""
    return communities.select("chat_id", "id", "title", *[F.greatest(F.lit(0), F.size(c)).alias(n) for c, n in (("node_keys", "members"), ("findings", "findings"))])


def dashboard(memories: DataFrame, states: DataFrame, communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """A line for each chat: all memories, reflections, those with a vector, archived ones, characters, communities and entities."""
    def has(c: str) -> Column:
        return F.count(F.when(F.col(c).isNotNull(), 1)) if c in memories.columns else F.lit(0).cast("long")

    rows = memories.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("memories"), F.count(F.when(F.col("type") == "reflection", 1)).alias("reflections"), has("embedding").alias("vectors"),
        F.count(F.when(F.coalesce("archived", F.lit(False)), 1)).alias("archived"),
    )
    for table, name in ((states, "characters"), (communities, "communities"), (nodes, "entities")):
        rows = rows.join(table.groupBy("chat_id").agg(F.count(F.lit(1)).alias(name)), "chat_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def vector_counts(**tables: DataFrame) -> DataFrame:
    """chat_id, kind, vectors: rows with a vector in each of several tables."""
    parts = [t.filter(F.col("embedding").isNotNull()).select("chat_id", F.lit(kind).alias("kind")) for kind, t in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("chat_id", "kind").agg(F.count(F.lit(1)).alias("vectors"))


def extraction_stats(messages: DataFrame, done: DataFrame, batch: int, buffer: int = 0) -> DataFrame:
    """chat_id, total, hidden, extracted, extractable, unextracted, in_batch, needed: how far extraction is, and what the next batch of ``batch`` messages lacks.

    Processed fingerprints that no message has any more don't count. The last ``buffer`` messages aren't to be extracted yet.
    """
    mark = done.select("chat_id", "fingerprint").distinct().withColumn("__d", F.lit(True))
    rows = messages.join(mark, ["chat_id", "fingerprint"], "left")
    per = rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("is_system"), 1)).alias("hidden"), F.count(F.when(~F.col("is_system") & F.col("__d"), 1)).alias("extracted")
    )
    per = per.withColumn("extractable", F.greatest(F.lit(0), F.col("total") - buffer)).withColumn("unextracted", F.greatest(F.lit(0), F.col("extractable") - F.col("extracted")))
    per = per.withColumn("in_batch", F.col("unextracted") % batch)
    return per.withColumn("needed", F.when((F.col("in_batch") == 0) & (F.col("unextracted") > 0), 0).otherwise(batch - F.col("in_batch")))


def budget_use(messages: DataFrame, done: DataFrame, budget: int, batch_budget: int) -> DataFrame:
    """chat_id, visible, waiting and both as a percentage of their budgets, 100 at most: tokens that a chat shows, and those still to be extracted."""
    mark = done.select("chat_id", "fingerprint").distinct().withColumn("__d", F.lit(True))
    rows = messages.filter(~F.col("is_system")).join(mark, ["chat_id", "fingerprint"], "left")
    per = rows.groupBy("chat_id").agg(F.sum("n_tokens").cast("long").alias("visible"), F.sum(F.when(F.col("__d").isNull(), F.col("n_tokens")).otherwise(0)).cast("long").alias("waiting"))

    def share(c: str, of: int) -> Column:
        return F.least(F.lit(100), text.half_up(100 * F.col(c) / of)).cast("long")

    return per.select("*", share("visible", budget).alias("visible_percent"), share("waiting", batch_budget).alias("waiting_percent"))


def report(**parts: DataFrame) -> DataFrame:
    """chat_id, report: the rows of several small tables with chat_id as one JSON text for each chat, each under its name; for listings of bounded size only."""
    out = None
    for name, table in parts.items():
        fields = [c for c in table.columns if c != "chat_id"]
        one = table.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = one if out is None else out.join(one, "chat_id", "full")
    return out.select("chat_id", F.to_json(F.struct(*parts)).alias("report"))


def newest_first(column: str = "sequence") -> list[Column]:
    return [F.desc(F.coalesce(F.col(column), F.lit(0))), F.col("ord")]


def page(df: DataFrame, order: list[Column], number: int, size: int = DEFAULTS.page_size) -> DataFrame:
    """A page of a listing, numbered from 0; beyond the last page the last one."""
    total = df.count()
    last = max(1, -(-total // size)) - 1
    number = min(max(number, 0), last)
    return df.orderBy(*order).offset(number * size).limit(size)


def timeline(memories: DataFrame, width: int = 20) -> DataFrame:
    """chat_id, phase, first_message, last_message, n: phases of ``width`` messages; memories without a message form one phase of their own."""
    phase = F.when(F.col("message_id").isNotNull(), F.floor(F.col("message_id") / width)).otherwise(-1)
    return memories.groupBy("chat_id", phase.alias("phase")).agg(F.min("message_id").alias("first_message"), F.max("message_id").alias("last_message"), F.count(F.lit(1)).alias("n"))


def runs(rows: DataFrame, value: str) -> DataFrame:
    """chat_id, run, value, start, end, n: stretches of equal values in order of ``ord``, whatever the size of a chat."""
    from . import ranking

    placed = ranking.beside(ranking.place(rows, "chat_id", "ord", [], 1000), "chat_id", "place", value, -1, "__last")
    new = F.when((F.col("place") > 1) & F.col(value).eqNullSafe(F.col("__last")), 0).otherwise(1)
    marked = ranking.running(placed, "chat_id", "place", [], 1000, run=new)
    return marked.groupBy("chat_id", "run").agg(F.min_by(value, "place").alias(value), F.min("ord").alias("start"), F.max("ord").alias("end"), F.count(F.lit(1)).alias("n"))


def dossier(memories: DataFrame, edges: DataFrame, nodes: DataFrame, state: DataFrame, reflect_at: int = DEFAULTS.reflect_at) -> DataFrame:
    """A line for each character: its memories, reflections by level, relations and how near the next reflection is."""
    people = memories.select("chat_id", F.explode("characters").alias("character"), "type", "level")
    counts = people.groupBy("chat_id", "character").agg(
        F.count(F.when(F.col("type") == "event", 1)).alias("events"),
        *[F.count(F.when((F.col("type") == "reflection") & (F.col("level") == n), 1)).alias(f"reflections_{n}") for n in (1, 2, 3)],
    )
    both = edges.select("chat_id", F.col("source").alias("key"), "weight").unionByName(edges.select("chat_id", F.col("target").alias("key"), "weight"))
    relations = both.groupBy("chat_id", "key").agg(F.count(F.lit(1)).alias("relations"), F.sum("weight").alias("weight"))
    named = nodes.select("chat_id", "key", F.lower("name").alias("k")).join(relations, ["chat_id", "key"], "left")
    rows = counts.withColumn("k", F.lower("character")).join(named.drop("key"), ["chat_id", "k"], "left").join(state, ["chat_id", "character"], "left")
    near = F.least(F.lit(1.0), F.coalesce("importance_sum", F.lit(0)) / F.lit(float(reflect_at)))
    return rows.select("chat_id", "character", "events", "reflections_1", "reflections_2", "reflections_3", F.coalesce("relations", F.lit(0)).alias("relations"), near.alias("progress"))


def last_values(measures: DataFrame) -> DataFrame:
    """The last value of each metric of a chat."""
    return measures.groupBy("chat_id", "metric").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.count(F.lit(1)).alias("n"))


def evidence(reflections: DataFrame, memories: DataFrame) -> DataFrame:
    """chat_id, id, place, source_id, missing: what each reflection rests on, and whether that is still there."""
    rows = reflections.select("chat_id", "id", F.posexplode("source_ids").alias("place", "source_id"))
    there = memories.select("chat_id", F.col("id").alias("source_id"), F.lit(True).alias("there"))
    return rows.join(there, ["chat_id", "source_id"], "left").select("chat_id", "id", "place", "source_id", F.col("there").isNull().alias("missing"))
