"""Micro-batches of a message stream: a chat's messages are held until they fill a token budget at the end of a turn."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scheduling
from ..shipping import ship_code

OUTPUT = "chat_id long, batch long, first_idx long, last_idx long, messages long, tokens long"
STATE = "batch long, low array<long>, high array<long>, idx array<long>, tokens array<long>, is_user array<boolean>"


def add_to_ranges(ranges: list[list[int]], i: int) -> bool:
    """Add a number to sorted ranges [low, high] of numbers seen so far; False if it was in them."""
    at = bisect.bisect_right(ranges, i, key=lambda r: r[0])
    if at and ranges[at - 1][1] >= i:
        return False
    left, right = at > 0 and ranges[at - 1][1] == i - 1, at < len(ranges) and ranges[at][0] == i + 1
    if left and right:
        ranges[at - 1][1] = ranges.pop(at)[1]
    elif left:
        ranges[at - 1][1] = i
    elif right:
        ranges[at][0] = i
    else:
        ranges.insert(at, [i, i])
    return True


def advance(held: list[tuple[int, int, bool]], budget: int) -> tuple[list[list[tuple[int, int, bool]]], list[tuple[int, int, bool]]]:
    """(full batches, what is still held) of messages (idx, tokens, is_user) in order.

    A batch is full once its tokens reach the budget and a turn is over: an answer that the user has replied to. The latest message is always
    held back, as it may yet change.
    """
    batches, start, total = [], 0, 0
    for i, (_, tokens, is_user) in enumerate(held[:-1]):
        total += tokens
        if total >= budget and not is_user and held[i + 1][2]:
            batches.append(held[start : i + 1])
            start, total = i + 1, 0
    return batches, held[start:]


def micro_batches(messages: DataFrame, budget: int) -> DataFrame:
    """Batches of a stream of messages (chat_id, idx, n_tokens, is_user).

    A message counts once: those seen before are ignored, so a replay emits nothing. One that comes late, after later ones were already handed out, goes into the
    next batch. The state of a chat is what it holds back, less than a budget and a turn, and the ranges of the messages seen, as many as there are gaps.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, ranges, held = 0, [], []
        if state.exists:
            batch, low, high, idx, tokens, user = state.get
            ranges, held = [list(r) for r in zip(low, high)], list(zip(idx, tokens, user))
        new = pd.concat(list(parts)).drop_duplicates("idx").sort_values("idx")
        held += [(int(i), int(t), bool(u)) for i, t, u in zip(new["idx"], new["n_tokens"], new["is_user"]) if add_to_ranges(ranges, int(i))]
        full, held = advance(sorted(held), budget)
        rows = [(key[0], batch + k, b[0][0], b[-1][0], len(b), sum(x[1] for x in b)) for k, b in enumerate(full)]
        state.update((batch + len(full), [r[0] for r in ranges], [r[1] for r in ranges], [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]))
        yield pd.DataFrame(rows, columns=["chat_id", "batch", "first_idx", "last_idx", "messages", "tokens"])

    ship_code(messages.sparkSession)
    return messages.groupBy("chat_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def all_batches(messages: DataFrame, budget: int) -> DataFrame:
    """The same batches of a finished log, as joins and sums over all chats at once. Rows that repeat a message count once."""
    once = messages.dropDuplicates(["chat_id", "idx"]).withColumn("is_system", F.lit(False))
    return scheduling.turn_batches(once, budget).select("chat_id", "batch", "first_idx", "last_idx", "messages", "tokens")


def write_once(table: DataFrame, path: str, checkpoint: str):
    """Run a stream of batches over everything that is there and append it; a rerun with the same checkpoint adds only what is new."""
    return table.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
