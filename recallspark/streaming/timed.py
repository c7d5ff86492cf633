"""Micro-batches with timers: list and value states of Spark's stateful processors, and chats that end when they fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship_code
from . import batches

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def states(spark: SparkSession):
    """Queries that are started within it keep their states in RocksDB, which stateful processors need; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Batches(StatefulProcessor):
    """Holds a chat's messages back until they fill a budget at the end of a turn (``batches.advance``).

    States: the held messages and the ranges of numbers seen as lists, the number of the next batch as a value. With ``idle`` milliseconds a timer is set to the last message's time and that long; when
    the watermark passes it, the chat is over: what is held is handed out as its last batch, and what is known of the chat is forgotten.
    """

    def __init__(self, budget: int, idle: int | None = None):
        self.budget, self.idle = budget, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "idx long, tokens long, is_user boolean")
        self.ranges = handle.getListState("ranges", "low long, high long")
        self.next = handle.getValueState("next", "batch long, last long")

    def _rows(self, chat, first: int, full: list) -> pd.DataFrame:
        rows = [(chat, first + k, b[0][0], b[-1][0], len(b), sum(x[1] for x in b)) for k, b in enumerate(full)]
        return pd.DataFrame(rows, columns=["chat_id", "batch", "first_idx", "last_idx", "messages", "tokens"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, last = self.next.get() if self.next.exists() else (0, 0)
        ranges = [list(r) for r in self.ranges.get()]
        held = [tuple(h) for h in self.held.get()]
        new = pd.concat(list(rows))
        if self.idle is not None:
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            last = max(last, int(new["at_ms"].max()))
            self.handle.registerTimer(last + self.idle)
        new = new.drop_duplicates("idx").sort_values("idx")
        held += [(int(i), int(t), bool(u)) for i, t, u in zip(new["idx"], new["n_tokens"], new["is_user"], strict=True) if batches.add_to_ranges(ranges, int(i))]
        full, held = batches.advance(sorted(held), self.budget)
        self.next.update((batch + len(full), last))
        self.ranges.put([tuple(r) for r in ranges])
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        yield self._rows(key[0], batch, full)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(h) for h in self.held.get())
        batch = self.next.get()[0] if self.next.exists() else 0
        for state in (self.held, self.ranges, self.next):
            state.clear()
        yield self._rows(key[0], batch, [held] if held else [])

    def close(self) -> None:
        pass


def micro_batches(messages: DataFrame, budget: int, idle: int | None = None) -> DataFrame:
    """Batches (``batches.OUTPUT``) of a stream of messages (chat_id, idx, n_tokens, is_user). A message counts once, and a late one joins the next batch.

    With ``idle`` messages also have ``at``, a timestamp with a watermark, and ``at_ms``, the same in milliseconds, and chats end.
    """
    ship_code(messages.sparkSession)
    mode = "none" if idle is None else "eventTime"
    return messages.groupBy("chat_id").transformWithStateInPandas(Batches(budget, idle), batches.OUTPUT, "append", mode)

