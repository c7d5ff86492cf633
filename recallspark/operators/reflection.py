"""Reflections: what a character has lived through, and how many thoughts it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from . import ranking, scoring


def accumulate(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """chat_id, character, importance_sum: each event's importance goes to everybody who took part or watched, once."""
    people = F.explode(F.array_union("characters", F.coalesce("witnesses", F.array().cast("array<string>"))))
    sums = events.select("chat_id", people.alias("character"), scoring.importance().alias("i")).groupBy("chat_id", "character").agg(F.sum("i").cast("long").alias("importance_sum"))
    if state is None:
        return sums
    return state.select("chat_id", "character", "importance_sum").unionByName(sums).groupBy("chat_id", "character").agg(F.sum("importance_sum").cast("long").alias("importance_sum"))


def due(state: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Characters whose sum reached the threshold."""
    return state.filter(F.col("importance_sum") >= settings.reflect_at)


def over_cap(reflections: DataFrame, cap: int = DEFAULTS.reflections_kept) -> DataFrame:
    """chat_id, id: the oldest reflections of characters at their cap, so that one more has room.

    The newest cap - 1 are what stays; they are found as top rows, the rest is archived.
    """
    full = reflections.groupBy("chat_id", "character").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap)
    rows = reflections.join(full, ["chat_id", "character"], "left_semi")
    kept = ranking.top_n(rows, ["chat_id", "character"], [F.desc("sequence"), F.desc("ord")], cap - 1)
    return rows.select("chat_id", "id").join(kept.select("chat_id", "id"), ["chat_id", "id"], "left_anti")


def levels(new: DataFrame, memories: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """New reflections (chat_id, id, parent_ids) with their level: one above their highest parent, up to the limit; 1 without parents."""
    parents = new.select("chat_id", "id", F.explode("parent_ids").alias("parent")).join(memories.select("chat_id", F.col("id").alias("parent"), "level"), ["chat_id", "parent"])
    top = parents.groupBy("chat_id", "id").agg(F.max(F.coalesce("level", F.lit(1))).alias("top"))
    level = F.least(F.lit(settings.reflection_levels), 1 + F.col("top"))
    return new.join(top, ["chat_id", "id"], "left").withColumn("level", F.when(F.col("top").isNotNull(), level).otherwise(F.lit(1))).drop("top")


def candidates(memories: DataFrame, limit: int = 50) -> DataFrame:
    """The newest memories of each character that a reflection is drawn from."""
    return ranking.top_n(memories, ["chat_id", "character"], [F.desc("sequence"), F.col("ord")], limit)
