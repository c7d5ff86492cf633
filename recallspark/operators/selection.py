"""Choosing scored memories under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from . import ranking, scoring

KEY = ["query_id", "chat_id"]


def bucket(position: Column, chat_length: Column, clamp: bool = True) -> Column:
    """recent (last 100 messages), mid (last 500) or old."""
    recent, mid = chat_length - 100, chat_length - 500
    if clamp:
        recent, mid = F.greatest(F.lit(0), recent), F.greatest(F.lit(0), mid)
    return F.when(position >= recent, "recent").when(position >= mid, "mid").otherwise("old")


def soft_balance(scored: DataFrame, budget: int, share: float = DEFAULTS.bucket_share) -> DataFrame:
    """Rows (with score, ord, bucket, n_tokens) chosen under a budget: first a share for each bucket, then the best of the rest.

    Both steps stop at the first row that doesn't fit. Give it the top rows only (``scoring.best``), which bounds a group.
    """
    order = [F.desc("score"), F.col("ord")]
    first = ranking.budget_prefix(scored, [*KEY, "bucket"], order, "n_tokens", budget * share)
    used = first.groupBy(*KEY).agg(F.sum("n_tokens").alias("__used"))
    rest = scored.join(first.select(*KEY, "id"), [*KEY, "id"], "left_anti").join(used, KEY, "left")
    second = ranking.budget_prefix(rest, KEY, order, "n_tokens", budget - F.coalesce("__used", F.lit(0)))
    return first.withColumn("phase", F.lit(1)).drop("used").unionByName(second.withColumn("phase", F.lit(2)).drop("used", "__used"))


def cap_importance(chosen: DataFrame, candidates: DataFrame, budget: int, cap: int = DEFAULTS.top_importance_cap) -> DataFrame:
    """At most ``cap`` rows of importance 5 stay; others that weren't chosen fill the budget, best first."""
    order = [F.desc("score"), F.col("ord")]
    five = scoring.importance() == 5
    placed = chosen.withColumn("__five", five).withColumn("__r", F.row_number().over(Window.partitionBy(*KEY, "__five").orderBy(*order)))
    kept = placed.filter(~F.col("__five") | (F.col("__r") <= cap)).drop("__five", "__r")
    dropped = placed.filter(F.col("__five") & (F.col("__r") > cap)).select(*KEY).distinct()
    used = kept.groupBy(*KEY).agg(F.sum("n_tokens").alias("__used"))
    free = candidates.filter(~five).join(dropped, KEY, "left_semi").join(chosen.select(*KEY, "id"), [*KEY, "id"], "left_anti").join(used, KEY, "left")
    more = ranking.budget_prefix(free, KEY, order, "n_tokens", budget - F.coalesce("__used", F.lit(0))).drop("used", "__used")
    return kept.unionByName(more.withColumn("phase", F.lit(3)), allowMissingColumns=True)


def rearview(memories: DataFrame, budget: int) -> DataFrame:
    """Memories shown to an extraction: a quarter of the budget for the newest, the rest for importance 4 and over, what is left for newer ones."""
    recency = budget // 4
    important = budget - recency
    newest = [F.desc(F.coalesce("sequence", F.lit(0))), F.col("ord")]
    # No prefix is longer than its budget, as each memory with text takes a token or more.
    pool = memories.filter(F.col("n_tokens") > 0)
    recent = ranking.budget_prefix(ranking.top_n(pool, ["chat_id"], newest, recency), ["chat_id"], newest, "n_tokens", recency).drop("used", "rank")
    rest = pool.join(recent.select("chat_id", "id"), ["chat_id", "id"], "left_anti")
    by_importance = [F.desc(scoring.importance()), *newest]
    high = ranking.top_n(rest.filter(scoring.importance() >= 4), ["chat_id"], by_importance, important)
    high = ranking.budget_prefix(high, ["chat_id"], by_importance, "n_tokens", important).drop("used", "rank")
    used = high.groupBy("chat_id").agg(F.sum("n_tokens").alias("__used"))
    left = rest.join(high.select("chat_id", "id"), ["chat_id", "id"], "left_anti")
    fill = ranking.top_n(left, ["chat_id"], newest, important).join(used, "chat_id", "left")
    fill = ranking.budget_prefix(fill, ["chat_id"], newest, "n_tokens", important - F.coalesce("__used", F.lit(0))).drop("used", "rank", "__used")
    return recent.withColumn("step", F.lit("recent")).unionByName(high.withColumn("step", F.lit("important"))).unionByName(fill.withColumn("step", F.lit("fill")))


def split_budget(total: Column, settings: Settings = DEFAULTS) -> Column:
    """scene, entity and world budgets."""
    return F.struct(*[F.floor(total * s).alias(n) for n, s in (("scene", settings.scene_share), ("entity", settings.entity_share), ("world", settings.world_share))])


def bucket_tokens(rows: DataFrame) -> DataFrame:
    """chat_id and the tokens of its rows in each bucket, side by side."""
    return rows.groupBy("chat_id").pivot("bucket", ["old", "mid", "recent"]).agg(F.sum("n_tokens")).fillna(0, ["old", "mid", "recent"])
