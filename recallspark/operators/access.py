"""Who may see a memory, and who is present."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def expand_names(viewers: DataFrame, nodes: DataFrame) -> DataFrame:
    """chat_id, names: the viewers (chat_id, name) of each chat in lower case with the aliases of their nodes."""
    known = nodes.select("chat_id", text.entity_key(F.col("name")).alias("k"), F.transform("aliases", lambda a: F.lower(a)).alias("aliases"))
    joined = viewers.withColumn("k", text.entity_key(F.col("name"))).join(known, ["chat_id", "k"], "left")
    names = F.array_union(F.array(F.lower("name")), F.coalesce("aliases", F.array().cast("array<string>")))
    return joined.select("chat_id", F.explode(names).alias("n")).groupBy("chat_id").agg(F.array_sort(F.collect_set("n")).alias("names"))


def visible(memories: DataFrame, names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Memories that one of a chat's viewers witnessed, took part in, or knows of (chat_id, id). Chats without viewers see everything."""
    seen = memories.join(names, "chat_id", "left")

    def lower(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x))

    allowed = F.col("names").isNull() | F.arrays_overlap(lower("witnesses"), F.col("names")) | F.arrays_overlap(lower("characters"), F.col("names"))
    if known is not None:
        seen = seen.join(known.select("chat_id", "id").distinct().withColumn("known", F.lit(True)), ["chat_id", "id"], "left")
        allowed = allowed | F.coalesce("known", F.lit(False))
    return seen.filter(allowed).drop("names", "known")


def on_hidden_messages(memories: DataFrame, messages: DataFrame) -> DataFrame:
    """Memories whose first source message left the chat: it is a system or hidden message, or none of the fingerprints is found.

    ``fingerprints`` are looked up first (a repeated one means its last message), then ``message_ids``; memories with neither are left out.
    """
    last = messages.groupBy("chat_id", "fingerprint").agg(F.max("idx").alias("idx"))
    by_print = memories.select("chat_id", "id", F.explode("fingerprints").alias("fingerprint")).join(last, ["chat_id", "fingerprint"], "left")
    first = by_print.groupBy("chat_id", "id").agg(F.min("idx").alias("print_idx"), F.lit(True).alias("has_print"))
    ids = F.when(F.size("message_ids") > 0, F.array_min("message_ids"))
    rows = memories.join(first, ["chat_id", "id"], "left").withColumn("idx", F.when(F.col("has_print"), F.col("print_idx")).otherwise(ids))
    hidden = messages.select("chat_id", "idx", F.col("is_system").alias("__hidden"))
    rows = rows.join(hidden, ["chat_id", "idx"], "left")
    lost = F.col("has_print") & F.col("print_idx").isNull()
    return rows.filter(F.coalesce(lost, F.lit(False)) | F.coalesce("__hidden", F.lit(False))).drop("idx", "print_idx", "has_print", "__hidden")


def orphaned(memories: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, id of memories whose source left the chat: none of their fingerprints is found, or, without any, their first message id lies beyond the chat's end.

    In a chat without messages nothing is orphaned, as it may not be loaded.
    """
    sizes = messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("__n"))
    known = messages.select("chat_id", "fingerprint").distinct().withColumn("__there", F.lit(1))
    prints = memories.select("chat_id", "id", F.explode("fingerprints").alias("fingerprint")).join(known, ["chat_id", "fingerprint"], "left")
    prints = prints.groupBy("chat_id", "id").agg(F.max("__there").isNull().alias("__lost"))
    first = F.when(F.size("message_ids") > 0, F.element_at("message_ids", 1))
    rows = memories.join(sizes, "chat_id").join(prints, ["chat_id", "id"], "left")
    return rows.filter(F.coalesce("__lost", (first > 0) & (first >= F.col("__n")), F.lit(False))).select("chat_id", "id")


def active_characters(main: Column, user: Column, group: Column) -> Column:
    """The main character, the user and a group's members, each once."""
    return F.filter(F.array_distinct(F.concat(F.array(main, user), F.coalesce(group, F.array().cast("array<string>")))), lambda n: n.isNotNull())


def present(messages: DataFrame, names: list[str], last: int = 2) -> DataFrame:
    """chat_id, name: the names said, as whole words, in the last messages of each chat."""
    newest = messages.groupBy("chat_id").agg(F.max("idx").alias("newest"))
    recent = messages.join(newest, "chat_id").filter(F.col("idx") > F.col("newest") - last)
    spoken = F.filter(
        F.array(*[F.when(F.col("mes").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(n)}(?![\p{{L}}\p{{N}}])"), F.lit(n)) for n in names]), lambda n: n.isNotNull()
    )
    return recent.select("chat_id", F.explode(spoken).alias("name")).distinct()
