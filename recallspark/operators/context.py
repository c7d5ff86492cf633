"""Texts for a prompt: memories by age, entities and the state of the world."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text, vector
from . import graph, ranking

# What stands around the lines of entities.
ENTITY_TAGS = "<entity_context>\n</entity_context>"


def memory_line(importance: Column, anchor: Column, known: Column, summary: Column) -> Column:
    """[stars] [anchor] [Known] summary; the parts that are missing are left out."""
    mark = F.concat(F.lit("["), F.repeat(F.lit("★"), F.coalesce(F.nullif(importance, F.lit(0)), F.lit(3)).cast("int")), F.lit("]"))
    return F.concat_ws(" ", mark, F.when(F.length(anchor) > 0, F.concat(F.lit("["), anchor, F.lit("]"))), F.when(known, F.lit("[Known]")), summary)


def gaps(memories: DataFrame) -> DataFrame:
    """Old memories in order of position with ``gap``: what stands between one and the one before it."""
    step = F.col("position") - F.lag("position").over(Window.partitionBy("query_id", "chat_id").orderBy("position", "ord"))
    far = F.when(step >= 500, "...Much later...").when(step >= 100, "...Later...").when(step >= 15, "...")
    return memories.withColumn("gap", F.when(F.col("bucket") == "old", far))


def memory_block(selected: DataFrame) -> DataFrame:
    """query_id, chat_id, block: the lines of the selected memories, oldest first, under a head for each age."""
    rows = gaps(selected).withColumn("line", F.concat_ws("\n", "gap", memory_line(F.col("importance"), F.lit(None).cast("string"), F.lit(False), F.col("summary"))))
    order = F.when(F.col("bucket") == "old", 0).when(F.col("bucket") == "mid", 1).otherwise(2)
    per = rows.groupBy("query_id", "chat_id", "bucket", order.alias("o")).agg(F.array_sort(F.collect_list(F.struct("position", "ord", "line"))).alias("l"))
    heads = F.when(F.col("bucket") == "old", "## Long ago").when(F.col("bucket") == "mid", "## Earlier").otherwise("## Lately")
    part = F.concat_ws("\n", heads, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return per.groupBy("query_id", "chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("block"))


def community_entry(title: Column, summary: Column, findings: Column) -> Column:
    """A community as a part of a prompt."""
    lines = F.array_join(F.transform(findings, lambda f: F.concat(F.lit("\n  - "), f)), "")
    return F.concat(F.lit("## "), title, F.lit("\n"), summary, F.when(F.size(findings) > 0, F.concat(F.lit("\nKey findings:"), lines)).otherwise(""))


def world_context(communities: DataFrame, states: DataFrame, queries: DataFrame, budget: int = 2000) -> DataFrame:
    """query_id, chat_id, source, content: the global state where the query asks for the whole picture, else the communities nearest to it that fit.

    ``queries`` holds query_id, chat_id, said and query_vector; a chat's communities are compared with its own queries only.
    """
    wide = queries.filter(text.macro_intent(F.col("said")))
    whole = wide.join(states.select("chat_id", "summary"), "chat_id").select("query_id", "chat_id", F.lit("global").alias("source"), F.col("summary").alias("content"))
    narrow = queries.join(whole.select("query_id"), "query_id", "left_anti")
    entry = community_entry(F.col("title"), F.col("summary"), F.col("findings"))
    rows = communities.withColumn("entry", entry).join(narrow, "chat_id").withColumn("s", vector.cosine(F.col("embedding"), F.col("query_vector")))
    rows = rows.withColumn("n_tokens", text.token_count(F.col("entry")))
    order = [F.desc("s"), F.col("ord")]
    fit = ranking.budget_prefix(ranking.top_n(rows, ["query_id", "chat_id"], order, budget), ["query_id", "chat_id"], order, "n_tokens", budget)
    local = fit.groupBy("query_id", "chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("content"))
    local = local.withColumn("content", F.concat(F.lit("<world_context>\n"), "content", F.lit("\n</world_context>")))
    return whole.unionByName(local.select("query_id", "chat_id", F.lit("communities").alias("source"), "content"))


def entity_context(nodes: DataFrame, edges: DataFrame, detected: DataFrame, active: DataFrame, budget: int) -> DataFrame:
    """chat_id, key, line, hop: the detected entities and those one step away, without the active ones, as far as the budget reaches.

    The tags around the lines (``entity_block``) are paid for first.
    """
    chosen = detected.select("chat_id", "key").distinct()
    near = graph.neighbours(edges, chosen)
    rows = chosen.withColumn("hop", F.lit(0)).withColumn("weight", F.lit(0)).unionByName(near.select("chat_id", "key", F.lit(1).alias("hop"), "weight"))
    rows = rows.join(active.select("chat_id", "key"), ["chat_id", "key"], "left_anti").join(nodes.select("chat_id", "key", "name", "type", "description"), ["chat_id", "key"])
    kind = F.when(F.length("type") > 0, F.concat(F.lit(" ["), F.col("type"), F.lit("]"))).otherwise("")
    rows = rows.withColumn("line", F.concat(F.col("name"), kind, F.lit(": "), F.coalesce("description", F.lit(""))))
    rows = rows.withColumn("n_tokens", text.token_count(F.col("line")))
    order = [F.col("hop"), F.desc("weight"), F.col("key")]
    room = budget - (len(ENTITY_TAGS) + 3) // 4
    kept = ranking.budget_prefix(ranking.top_n(rows, ["chat_id"], order, max(1, budget)), ["chat_id"], order, "n_tokens", room)
    return kept.select("chat_id", "key", "line", "hop", "rank")


def entity_block(lines: DataFrame) -> DataFrame:
    """chat_id, block: the lines of ``entity_context`` between their tags."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    start, end = ENTITY_TAGS.split("\n")
    return lines.groupBy("chat_id").agg(F.concat(F.lit(start + "\n"), joined, F.lit("\n" + end)).alias("block"))


def gap_notice(block: Column, hidden: Column) -> Column:
    """The block with a note on how many messages, and turns of two, the reader doesn't see."""
    note = F.concat(F.lit("("), hidden.cast("string"), F.lit(" earlier messages, about "), F.ceil(hidden / 2).cast("string"), F.lit(" turns, are not shown)\n"))
    return F.when(hidden > 0, F.concat(note, block)).otherwise(block)


def payload(total: Column, overhead: int = 2000) -> Column:
    """green, yellow, orange or red for the size of a request."""
    size = total + overhead
    return F.when(size <= 32000, "green").when(size <= 48000, "yellow").when(size <= 64000, "orange").otherwise("red")
