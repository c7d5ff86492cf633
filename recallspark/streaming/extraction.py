"""Extraction in two phases: what a batch yields is safe before anything is made of it, and what fails then is made up for later."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..functions import codec

LOG = logging.getLogger(__name__)
#: How often a batch without a result is tried again.
EMPTY_TRIES = 2


def batch_key(fingerprints) -> F.Column:
    """A key of a batch of messages that doesn't depend on their order."""
    return codec.text_hash(F.array_join(F.array_sort(fingerprints), "|")).cast("string")


def judge_results(results: DataFrame, tries: DataFrame, limit: int = EMPTY_TRIES) -> DataFrame:
    """chat_id, batch_key, tries, action of batches (chat_id, batch_key, n_events) and how often they came out empty so far (chat_id, batch_key, tries).

    done where there are events; an empty batch is tried again (retry) until it came out empty ``limit`` times before, and then given up: its messages count as processed.
    """
    rows = results.join(tries, ["chat_id", "batch_key"], "left").withColumn("before", F.coalesce("tries", F.lit(0)))
    action = F.when(F.col("n_events") > 0, "done").when(F.col("before") < limit, "retry").otherwise("give up")
    left = F.when(F.col("n_events") > 0, 0).otherwise(F.least(F.col("before") + 1, F.lit(limit)))
    return rows.select("chat_id", "batch_key", left.cast("long").alias("tries"), action.alias("action"))


class TwoPhaseSink:
    """A function for ``foreachBatch``: events of each micro-batch are written first, what enriches them after that and at best effort.

    ``extract`` makes events of a batch's rows, ``enrich`` makes something of events. Both results are written by batch number and attempt, and a manifest that
    is written last names the attempt that counts: what a lost attempt left is never read, and a batch that runs again replaces what it wrote. A
    failure to enrich is logged and leaves the batch pending; a batch without events is enriched like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, extract: Callable[[DataFrame], DataFrame], enrich: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.extract, self.enrich = spark, folder, extract, enrich

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        attempt = f"a{uuid.uuid4().hex}"
        df.drop("batch", "attempt").write.parquet(f"{self.folder}/{name}/batch={batch}/attempt={attempt}")
        entry = self.spark.range(1).select(F.lit(attempt).alias("attempt")).coalesce(1)
        entry.write.mode("overwrite").parquet(f"{self.folder}/manifest/{name}/batch={batch}")

    def _table(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{path}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _read(self, name: str) -> DataFrame | None:
        """What counts: batch and attempt are folders, so a join with the manifest reads no others."""
        rows, entries = self._table(name), self._table(f"manifest/{name}")
        if rows is None or entries is None:
            return None
        return rows.join(staging.small(entries), ["batch", "attempt"], "left_semi").drop("attempt")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        self._write(self.extract(rows), "events", batch)
        self._try(batch)

    def _try(self, batch: int) -> bool:
        try:
            self._write(self.enrich(self._read("events").filter(F.col("batch") == batch).drop("batch")), "enriched", batch)
            return True
        except Exception:  # whatever goes wrong here must not undo the first phase
            LOG.exception("batch %s is left pending", batch)
            return False

    def events(self) -> DataFrame | None:
        return self._read("events")

    def enriched(self) -> DataFrame | None:
        return self._read("enriched")

    def pending(self) -> list[int]:
        """Batches whose events haven't been enriched yet."""
        events, done = self._table("manifest/events"), self._table("manifest/enriched")
        if events is None:
            return []
        batches = events.select("batch")
        if done is not None:
            batches = batches.join(done.select("batch"), "batch", "left_anti")
        return sorted(r["batch"] for r in batches.collect())

    def catch_up(self) -> list[int]:
        """Enrich the pending batches; those that fail again are returned."""
        return [batch for batch in self.pending() if not self._try(batch)]
