"""Which messages to process next: turns, budgets and batches of a chat log.

A chat is ordered by ``idx``. No step gathers a chat: running sums go by stretches of messages, neighbours are met by their place, and
batches are found by jumps from start to start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import cut
from . import ranking

#: Values of idx that are numbered together.
STRETCH = 1000


def _numbered(messages: DataFrame, **sums) -> DataFrame:
    """Messages that aren't system rows with their ``place`` from 1, and running sums."""
    return ranking.running(messages.filter(~F.col("is_system")), "chat_id", "idx", [], STRETCH, place=F.lit(1), **sums)


def stands_for_others(extra: Column) -> Column:
    """Whether a message stands for a stretch of others: one of its further fields (JSON) is a list whose first entry is a message with a text and a name or a speaker."""
    fields = F.from_json(extra, "map<string,string>")

    def listed(value: Column) -> Column:
        # an entry that is no object has none of these fields
        spoken = F.get_json_object(value, "$[0].mes").isNotNull()
        return value.startswith("[") & spoken & (F.get_json_object(value, "$[0].name").isNotNull() | F.get_json_object(value, "$[0].is_user").isNotNull())

    return F.coalesce(F.exists(F.map_values(fields), lambda v: F.coalesce(listed(v), F.lit(False))), F.lit(False))


def unprocessed(messages: DataFrame, done: DataFrame, include_latest: bool = False) -> DataFrame:
    """Messages that aren't system rows nor done (chat_id, fingerprint); the chat's latest is held back."""
    rows = messages.filter(~F.col("is_system")).join(done.select("chat_id", "fingerprint").distinct(), ["chat_id", "fingerprint"], "left_anti")
    if include_latest:
        return rows
    latest = messages.groupBy("chat_id").agg(F.max("idx").alias("latest"))
    return rows.join(latest, "chat_id").filter("idx < latest").drop("latest")


def turns(messages: DataFrame) -> DataFrame:
    """chat_id, turns: answers that follow at least one message of the user."""
    rows = ranking.beside(_numbered(messages).select("chat_id", "place", "is_user"), "chat_id", "place", "is_user", -1, "asked")
    turn = (~F.col("is_user")) & F.coalesce("asked", F.lit(False))
    return rows.groupBy("chat_id").agg(F.sum(turn.cast("long")).alias("turns"))


def boundaries(messages: DataFrame) -> DataFrame:
    """Messages with ``boundary``: an answer after which the user speaks or nothing follows. System rows are passed over."""
    rows = ranking.beside(_numbered(messages), "chat_id", "place", "is_user", 1, "__next")
    return rows.withColumn("boundary", ~F.col("is_user") & F.coalesce("__next", F.lit(True))).drop("place", "__next").select(*messages.columns, "boundary")


def snap(messages: DataFrame) -> DataFrame:
    """The messages up to the last boundary of each chat."""
    ends = boundaries(messages).filter("boundary").groupBy("chat_id").agg(F.max("idx").alias("end"))
    return messages.join(ends, "chat_id").filter("idx <= end").drop("end")


def without_last_turns(messages: DataFrame, n: int = 1) -> DataFrame:
    """Each chat without its last ``n`` turns and the user's messages right before them."""
    rows = ranking.running(boundaries(messages), "chat_id", "idx", [], STRETCH, so_far=F.col("boundary").cast("int"))
    total = rows.groupBy("chat_id").agg(F.max("so_far").alias("all"))
    # the messages at or before the boundary that has n others after it
    return rows.join(total, "chat_id").filter(F.col("all") - F.col("so_far") + F.col("boundary").cast("int") > n).select(*messages.columns)


def batch_numbers(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (chat_id, idx, place, total, n_tokens, ends) with ``batch``, and ``whole``: whether the batch came to its end.

    ``total`` is the running sum of tokens. A batch ends at its first row with ``ends`` by which it has ``budget`` tokens, and the next one starts
    after it. For every row it is found where a batch would end that started there: the first end whose total is at least the row's own
    by the budget. Totals are cut into cells as wide as the budget, so that is sought in one cell, or is the first end of the next cell that has one. Which
    rows do start a batch follows by jumps from start to start, doubled in each round.
    """
    cell = F.floor(F.col("v") / budget)
    targets = rows.select("chat_id", "place", (F.col("total") - F.col("n_tokens") + budget).alias("v"), F.lit(0).alias("kind"))
    ends = rows.filter("ends").select("chat_id", "place", F.col("total").alias("v"), F.lit(1).alias("kind"))
    both = targets.unionByName(ends).withColumn("cell", cell).withColumn("far", F.floor(F.col("cell") / 1024))
    end = F.when(F.col("kind") == 1, F.col("place"))
    after = (Window.currentRow, Window.unboundedFollowing)
    own = F.min(end).over(Window.partitionBy("chat_id", "cell").orderBy("v", "kind", "place").rowsBetween(*after))
    sought = both.withColumn("own", own).filter("kind = 0")
    cells = both.groupBy("chat_id", "far", "cell").agg(F.min(end).alias("first"))
    fars = cells.groupBy("chat_id", "far").agg(F.min("first").alias("first"))
    following = (1, Window.unboundedFollowing)
    fars = fars.select("chat_id", "far", F.min("first").over(Window.partitionBy("chat_id").orderBy("far").rowsBetween(*following)).alias("beyond"))
    cells = cells.withColumn("near", F.min("first").over(Window.partitionBy("chat_id", "far").orderBy("cell").rowsBetween(*following)))
    cells = cells.join(fars, ["chat_id", "far"]).select("chat_id", "cell", F.coalesce("near", "beyond").alias("later"))
    jumps = sought.join(cells, ["chat_id", "cell"]).select("chat_id", "place", F.coalesce("own", "later").alias("end")).filter("end is not null")
    jumps = cut(jumps.select("chat_id", "place", (F.col("end") + 1).alias("next")))
    whole = jumps.select("chat_id", "place", F.lit(True).alias("whole"))
    starts = rows.filter("place = 1").select("chat_id", "place")
    while True:
        reached = starts.join(jumps, ["chat_id", "place"]).select("chat_id", F.col("next").alias("place"))
        if reached.isEmpty():
            break
        starts = cut(starts.unionByName(reached).distinct())
        further = jumps.select("chat_id", F.col("place").alias("next"), F.col("next").alias("next2"))
        jumps = cut(jumps.join(further, ["chat_id", "next"]).select("chat_id", "place", F.col("next2").alias("next")))
    marked = rows.join(starts.withColumn("__start", F.lit(1)), ["chat_id", "place"], "left")
    marked = marked.join(whole, ["chat_id", "place"], "left")
    numbered = ranking.running(marked, "chat_id", "place", [], STRETCH, batch=F.coalesce("__start", F.lit(0)), __done=F.when(F.col("__start") == 1, F.coalesce("whole", F.lit(False)).cast("int")).otherwise(0))
    # the batches that end come first in a chat, as only its last one may be open
    return numbered.withColumn("whole", F.col("batch") <= F.col("__done")).withColumn("batch", F.col("batch") - 1).drop("__start", "__done")


def next_batch(messages: DataFrame, done: DataFrame, budget: int, max_turns: int | None = None, held_turns: int = 1, everything: bool = False) -> DataFrame:
    """chat_id, idx: the messages that each chat's next extraction takes, or none.

    The oldest unprocessed messages until they have ``budget`` tokens, or ``max_turns`` turns; a chat that has neither is left alone. That is cut back to
    the last whole turn, or goes on to the end of the turn if not even one is whole, and the last ``held_turns`` turns of the chat are held back, as they may
    still change. With ``everything`` all that is unprocessed is taken, whatever the budget, up to the last message.
    """
    log = boundaries(messages)
    rows = unprocessed(messages, done, include_latest=everything).join(log.select("chat_id", "idx", "boundary"), ["chat_id", "idx"])
    rows = ranking.running(rows, "chat_id", "idx", [], STRETCH, tokens=F.col("n_tokens"), place=F.lit(1))
    before = ranking.beside(rows, "chat_id", "place", "is_user", -1, "__asked")
    answered = (~F.col("is_user") & F.coalesce("__asked", F.lit(False))).cast("int")
    rows = cut(ranking.running(before, "chat_id", "idx", [], STRETCH, turns=answered).drop("__asked"))
    if everything:
        return rows.select("chat_id", "idx")
    full = F.col("tokens") >= budget
    if max_turns is not None:
        full = full | (F.col("turns") >= max_turns)
    stop = rows.filter(full).groupBy("chat_id").agg(F.min("idx").alias("stop"))
    ends = rows.filter("boundary").join(stop, "chat_id").groupBy("chat_id", "stop").agg(
        F.max(F.when(F.col("idx") <= F.col("stop"), F.col("idx"))).alias("back"), F.min(F.when(F.col("idx") > F.col("stop"), F.col("idx"))).alias("on")
    )
    ends = ends.select("chat_id", F.coalesce("back", "on").alias("end"))
    held = ranking.running(log, "chat_id", "idx", [], STRETCH, so_far=F.col("boundary").cast("int"))
    total = held.groupBy("chat_id").agg(F.max("so_far").alias("all"))
    free = held.join(total, "chat_id").filter(F.col("all") - F.col("so_far") + F.col("boundary").cast("int") > held_turns).select("chat_id", "idx")
    return rows.join(ends, "chat_id").filter("idx <= end").select("chat_id", "idx").join(free, ["chat_id", "idx"], "left_semi")


def token_batches(messages: DataFrame, budget: int) -> DataFrame:
    """Messages with their ``batch``: a batch ends with the message that brings it to the budget, and the next starts from 0."""
    rows = cut(_numbered(messages, total=F.col("n_tokens")).select("chat_id", "idx", "place", "total", "n_tokens", F.lit(True).alias("ends")))
    return batch_numbers(rows, budget).select("chat_id", "idx", F.col("batch").cast("int").alias("batch"))


def turn_batches(messages: DataFrame, budget: int) -> DataFrame:
    """chat_id, batch, first_idx, last_idx, messages, tokens: the full batches of each chat.

    A batch is full once its tokens reach the budget and a turn is over, an answer that the user has replied to; so the latest message is always held back.
    """
    rows = ranking.beside(_numbered(messages, total=F.col("n_tokens")), "chat_id", "place", "is_user", 1, "__next")
    rows = cut(rows.select("chat_id", "idx", "place", "total", "n_tokens", (~F.col("is_user") & F.coalesce("__next", F.lit(False))).alias("ends")))
    full = batch_numbers(rows, budget).filter("whole")
    return full.groupBy("chat_id", "batch").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("messages"), F.sum("n_tokens").cast("long").alias("tokens")
    )


def frozen_prefix(messages: DataFrame, answers: int) -> DataFrame:
    """chat_id, frozen_until: the message with the n-th answer; the chat's start is never hidden before it."""
    rows = ranking.running(messages, "chat_id", "idx", [], STRETCH, n=(~F.col("is_user") & ~F.col("is_system")).cast("int"))
    return rows.filter(F.col("n") >= answers).groupBy("chat_id").agg(F.min("idx").alias("frozen_until"))


def to_hide(messages: DataFrame, token_budget: int, keep: int, frozen_answers: int = 0) -> DataFrame:
    """The oldest messages of each chat that must be hidden until both its tokens and its number of messages fit.

    The start of a chat up to its answer number ``frozen_answers`` is never hidden, and doesn't count.
    """
    if frozen_answers:
        frozen = frozen_prefix(messages, frozen_answers)
        messages = messages.join(frozen, "chat_id", "left").filter(F.col("idx") > F.col("frozen_until")).drop("frozen_until")
    rows = _numbered(messages, total=F.col("n_tokens"))
    whole = rows.groupBy("chat_id").agg((F.sum("n_tokens") - token_budget).alias("excess_tokens"), (F.count(F.lit(1)) - keep).alias("excess_rows"))
    rows = rows.join(whole, "chat_id")
    return rows.filter((F.col("total") - F.col("n_tokens") < F.col("excess_tokens")) | (F.col("place") - 1 < F.col("excess_rows"))).select("chat_id", "idx", "n_tokens")


def crossed(clock: DataFrame, every: int) -> DataFrame:
    """Ticks (chat_id, ord, count) at which the count passes a multiple of ``every``."""
    rows = ranking.beside(ranking.place(clock, "chat_id", "ord", [], STRETCH), "chat_id", "place", "count", -1, "__last")
    last = F.coalesce("__last", F.lit(0))
    return rows.filter(F.floor(F.col("count") / every) > F.floor(last / every)).select(*clock.columns)


def progress(messages: DataFrame, done: DataFrame) -> DataFrame:
    """chat_id, total, extracted, unextracted, tokens_left of messages that aren't system rows."""
    mark = done.select("chat_id", "fingerprint").distinct().withColumn("d", F.lit(True))
    rows = messages.filter(~F.col("is_system")).join(mark, ["chat_id", "fingerprint"], "left")
    is_done = F.coalesce("d", F.lit(False))
    return rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(is_done, 1)).alias("extracted"),
        F.count(F.when(~is_done, 1)).alias("unextracted"),
        F.sum(F.when(~is_done, F.col("n_tokens")).otherwise(0)).alias("tokens_left"),
    )
