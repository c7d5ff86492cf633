"""Changes to the store: each gives a new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language, text

ID = ["chat_id", "id"]


def union_first(first: DataFrame, second: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*(key or ID)), key or ID, "left_anti"), allowMissingColumns=True)


def update(memories: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Memories with the non-null fields of ``changes`` (chat_id, id, ...); a new summary makes the vector stale."""
    new = changes.select(*ID, *[F.col(f).alias(f"__{f}") for f in fields])
    rows = memories.join(new, ID, "left")
    if "summary" in fields and "embedding" in memories.columns:
        rows = rows.withColumn("embedding", F.when(F.col("__summary").isNull() | (F.col("__summary") == F.col("summary")), F.col("embedding")))
    return rows.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def delete(memories: DataFrame, gone: DataFrame) -> DataFrame:
    """Memories without ``gone`` (chat_id, id); the ids vanish from the source and parent lists of others too."""
    rows = memories.join(gone.select(*ID).distinct(), ID, "left_anti")
    for c in ("source_ids", "parent_ids"):
        if c in rows.columns:
            used = rows.select("chat_id", "id", F.posexplode(c).alias("p", "ref"))
            kept = used.join(gone.select("chat_id", F.col("id").alias("ref")).distinct(), ["chat_id", "ref"], "left_anti")
            lists = kept.groupBy("chat_id", "id").agg(F.array_sort(F.collect_list(F.struct("p", "ref"))).alias("__l"))
            rows = rows.join(lists, ID, "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(F.transform("__l", lambda x: x["ref"]), F.slice(c, 1, 0)))).drop("__l")
    return rows


def archive(memories: DataFrame, ids: DataFrame, archived: bool = True) -> DataFrame:
    mark = ids.select(*ID).distinct().withColumn("__m", F.lit(True))
    return memories.join(mark, ID, "left").withColumn("archived", F.when(F.col("__m"), F.lit(archived)).otherwise(F.coalesce("archived", F.lit(False)))).drop("__m")


def active(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.coalesce("archived", F.lit(False)))


def forget_character(memories: DataFrame, chat_id: str, name: str) -> DataFrame:
    """Memories of a chat without a character's name in their lists; the memories stay."""
    here = F.col("chat_id") == chat_id
    lists = [c for c in ("characters", "witnesses") if c in memories.columns]
    return memories.withColumns({c: F.when(here, F.array_remove(c, name)).otherwise(F.col(c)) for c in lists})


def count_hits(memories: DataFrame, selected: DataFrame) -> DataFrame:
    mark = selected.select(*ID).distinct().withColumn("__h", F.lit(1))
    return memories.join(mark, ID, "left").withColumn("retrieval_hits", F.coalesce("retrieval_hits", F.lit(0)) + F.coalesce("__h", F.lit(0))).drop("__h")


def advance(clock: DataFrame, done: DataFrame) -> DataFrame:
    """Each chat's clock (chat_id, count) moved on by its newly processed messages."""
    more = done.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    rows = clock.join(more, "chat_id", "full")
    return rows.select("chat_id", (F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("count"))


def merge_contradicting(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (chat_id, older, newer, summary): the older is archived, the newer takes the summary, the greater importance and both sources' names."""
    old = memories.select("chat_id", F.col("id").alias("older"), F.col("importance").alias("__i"))
    new = pairs.join(old, ["chat_id", "older"]).groupBy("chat_id", F.col("newer").alias("id")).agg(F.max("summary").alias("__s"), F.max("__i").alias("__i"), F.array_sort(F.collect_set("older")).alias("merge_sources"))
    gone = pairs.select("chat_id", F.col("older").alias("id"), F.col("newer").alias("merged_into")).groupBy(*ID).agg(F.min("merged_into").alias("merged_into"))
    rows = memories.join(new, ID, "left").join(gone, ID, "left")
    return rows.withColumns({
        "summary": F.coalesce("__s", "summary"),
        "importance": F.greatest("importance", F.coalesce("__i", "importance")),
        "archived": F.coalesce("archived", F.lit(False)) | F.col("merged_into").isNotNull(),
    }).drop("__s", "__i")


def canonical_names(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events with each character's name as ``names`` (chat_id, name) writes it: same letters first, then the other script."""
    said = events.select("chat_id", "id", F.posexplode("characters").alias("p", "said"))
    exact = names.select("chat_id", F.lower("name").alias("k"), F.col("name").alias("exact"))
    rows = said.withColumn("k", F.lower("said")).join(exact, ["chat_id", "k"], "left")
    from . import graph

    other = rows.filter(F.col("exact").isNull()).select("chat_id", F.col("said").alias("name"), F.lit("PERSON").alias("type")).distinct()
    found = graph.name_candidates(other, names.select("chat_id", F.lower("name").alias("key"), F.lit("PERSON").alias("type")))
    found = found.groupBy("chat_id", F.col("name").alias("k")).agg(F.min(F.struct("distance", "key")).alias("m")).select("chat_id", "k", F.col("m.key").alias("k2"))
    second = found.join(exact.select("chat_id", F.col("k").alias("k2"), F.col("exact").alias("script")), ["chat_id", "k2"]).select("chat_id", "k", "script")
    rows = rows.join(second, ["chat_id", "k"], "left").withColumn("name", F.coalesce("exact", "script", "said"))
    lists = rows.groupBy("chat_id", "id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"])).alias("__c"))
    return events.join(lists, ID, "left").withColumn("characters", F.coalesce("__c", "characters")).drop("__c")


def reclassify_transient(memories: DataFrame) -> DataFrame:
    """Memories whose summary tells a passing state are marked transient."""
    return memories.withColumn("is_transient", F.coalesce("is_transient", F.lit(False)) | text.looks_transient(F.col("summary")))


def enrich_events(events: DataFrame) -> DataFrame:
    """New events (chat_id, batch_id, message_ids, n, ...) with id, sequence, witnesses and defaults filled in."""
    first = F.coalesce(F.array_min("message_ids"), F.lit(0))
    seen = F.when(F.size("witnesses") > 0, F.col("witnesses")).otherwise(F.coalesce("characters", F.array().cast("array<string>")))
    return events.withColumns({
        "id": F.concat_ws("_", F.lit("event"), "batch_id", F.col("n").cast("string")),
        "sequence": first * 1000 + F.col("n"),
        "witnesses": seen,
        "importance": F.coalesce(F.nullif("importance", F.lit(0)), F.lit(3)),
        "is_transient": F.coalesce("is_transient", F.lit(False)),
    })


def character_states(events: DataFrame) -> DataFrame:
    """chat_id, character, emotion (of the last event that tells one), known_events (in order), first and last message."""
    rows = events.select("chat_id", "id", "ord", "message_ids", F.explode("emotions").alias("character", "emotion"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    return rows.groupBy("chat_id", "character").agg(
        F.max_by("emotion", F.when(F.col("emotion").isNotNull(), F.col("ord"))).alias("emotion"), F.array_distinct(ids).alias("known_events"), F.min(F.array_min("message_ids")).alias("first_message"), F.max(F.array_max("message_ids")).alias("last_message")
    )


def union_last(first: DataFrame, second: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows of both: of rows with one key the last one counts, at the place (``ord``) of the first."""
    key = key or ID
    rows = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (*key, "__side", "ord")]
    merged = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("__side", "ord")).alias("__r"), F.min_by("ord", F.struct("__side", "ord")).alias("ord"))
    return merged.select(*key, "__r.*", "ord")


def drop_states(states: DataFrame, gone: DataFrame) -> DataFrame:
    """Character states without those of ``gone`` (chat_id, character); memories aren't touched."""
    return states.join(gone.select("chat_id", "character").distinct(), ["chat_id", "character"], "left_anti")


def drop_chat(tables: dict[str, DataFrame], messages: DataFrame, chat_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without a chat's rows, and its messages shown again that had been hidden."""
    here = F.col("chat_id") == chat_id
    shown = messages.withColumn("is_system", F.when(here & F.coalesce("hidden", F.lit(False)), False).otherwise(F.col("is_system")))
    return {n: t.filter(~here) for n, t in tables.items()}, shown.withColumn("hidden", F.when(here, False).otherwise(F.coalesce("hidden", F.lit(False))))


def update_communities(communities: DataFrame, changes: DataFrame) -> DataFrame:
    """Communities with the title, summary and findings of ``changes``, where these aren't null; a new summary makes the vector stale."""
    return update(communities, changes, ["title", "summary", "findings"])


def drop_communities(communities: DataFrame, gone: DataFrame) -> DataFrame:
    return communities.join(gone.select(*ID).distinct(), ID, "left_anti")


def mark_processed(processed: DataFrame, done: DataFrame) -> DataFrame:
    """The log of processed fingerprints with new ones appended; repeats stay, as readers take it as a set."""
    return processed.select("chat_id", "fingerprint").unionByName(done.select("chat_id", "fingerprint"))


def valid_states(states: DataFrame, names: DataFrame, memories: DataFrame) -> DataFrame:
    """Character states of known names (chat_id, name) and of anybody in a memory, whatever the case and in either script."""
    known = names.select("chat_id", F.lower("name").alias("n")).unionByName(memories.select("chat_id", F.explode("characters").alias("n")).select("chat_id", F.lower("n").alias("n")))
    forms = known.select("chat_id", F.explode(F.array("n", language.transliterate(F.col("n")))).alias("n")).distinct()
    low = F.lower("character")
    own = F.when(F.col("character").rlike(r"\p{IsCyrillic}"), F.array(low, language.transliterate(low))).otherwise(F.array(low))
    valid = states.select("chat_id", "character", F.explode(own).alias("n")).join(forms, ["chat_id", "n"], "left_semi").select("chat_id", "character").distinct()
    return states.join(valid, ["chat_id", "character"], "left_semi")


def hide_processed(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages with those that are processed (chat_id, fingerprint) made system rows; ``hidden`` tells which were made so."""
    mark = done.select("chat_id", "fingerprint").distinct().withColumn("__d", F.lit(True))
    rows = messages.join(mark, ["chat_id", "fingerprint"], "left").withColumn("hidden", F.coalesce("__d", F.lit(False)) & ~F.col("is_system"))
    return rows.withColumn("is_system", F.col("is_system") | F.col("hidden")).drop("__d")


def settle_duplicates(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Memories after decisions on pairs (chat_id, first, second, action).

    keep-a deletes the second, keep-b the first; skip marks both as reviewed; merge does so too and gives the second the first's mentions, characters and summary.
    A memory is in one decision at most.
    """
    gone = decisions.filter("action in ('keep-a', 'keep-b')").select("chat_id", F.expr("if(action = 'keep-a', second, first)").alias("id"))
    seen = decisions.filter("action in ('skip', 'merge')").select("chat_id", F.explode(F.array("first", "second")).alias("id")).distinct().withColumn("__seen", F.lit(True))
    source = memories.select("chat_id", F.col("id").alias("first"), F.col("summary").alias("__s"), F.col("mentions").alias("__m"), F.col("characters").alias("__c"))
    merged = decisions.filter("action = 'merge'").join(source, ["chat_id", "first"]).select("chat_id", F.col("second").alias("id"), "__s", "__m", "__c", F.lit(True).alias("__merge"))
    rows = delete(memories, gone).join(seen, ID, "left").join(merged, ID, "left")

    def count(c: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))

    also = F.when(F.length("__s") > 0, F.concat(F.col("summary"), F.lit(" (also: "), F.col("__s"), F.lit(")"))).otherwise(F.col("summary"))
    return rows.withColumns({
        "mentions": F.when(F.col("__merge"), count("mentions") + count("__m")).otherwise(F.col("mentions")),
        "characters": F.when(F.col("__merge"), F.array_union(F.coalesce("characters", F.array().cast("array<string>")), F.coalesce("__c", F.array().cast("array<string>")))).otherwise(F.col("characters")),
        "summary": F.when(F.col("__merge"), also).otherwise(F.col("summary")),
        "reviewed": F.coalesce("__seen", F.lit(False)),
    }).drop("__seen", "__merge", "__s", "__m", "__c")


def without_vector(*tables: tuple[str, DataFrame, str]) -> DataFrame:
    """kind, chat_id, id, text: the rows of several tables, each given as (kind, table, text column), that have a text but no vector yet."""
    parts = [
        t.filter(F.col("embedding").isNull() & (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)).select(F.lit(kind).alias("kind"), "chat_id", F.col("id").cast("string").alias("id"), F.col(c).alias("text"))
        for kind, t, c in tables
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def add_vectors(table: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with the vectors (chat_id, id, embedding) that were made for them; those that have one keep it, and new ones aren't synchronised yet."""
    rows = table.join(vectors.select(*ID, F.col("embedding").alias("__v")), ID, "left")
    new = F.col("embedding").isNull() & F.col("__v").isNotNull()
    return rows.withColumn("synced", F.coalesce("synced", F.lit(False)) & ~new if "synced" in table.columns else ~new & F.lit(False)).withColumn("embedding", F.coalesce("embedding", "__v")).drop("__v")


def sync_changes(table: DataFrame) -> DataFrame:
    """chat_id, id, embedding, op: what an outside index must be told: vectors that it doesn't have yet, and archived rows that it still has."""
    synced, gone = F.coalesce("synced", F.lit(False)), F.coalesce("archived", F.lit(False))
    op = F.when(gone & synced, "delete").when(~gone & ~synced & F.col("embedding").isNotNull(), "sync")
    return table.select("chat_id", "id", "embedding", op.alias("op")).filter(F.col("op").isNotNull())


def last_to_judge(memories: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` memories of each chat that aren't marked transient, for a second judgement."""
    from . import ranking

    return ranking.top_n(memories.filter(~F.coalesce("is_transient", F.lit(False))), ["chat_id"], [F.desc(F.coalesce("sequence", F.lit(0))), F.desc("ord")], n)


def apply_judgement(memories: DataFrame, judged: DataFrame) -> DataFrame:
    """Memories with the transient flag of ``judged`` (chat_id, id, is_transient) where that isn't null."""
    return update(memories, judged, ["is_transient"])
