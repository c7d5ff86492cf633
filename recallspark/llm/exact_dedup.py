"""Exact dedup by a log-structured merge index of text digests.

Each task is a memtable: it flushes its records (digest, doc_id) as a run sorted
by digest. Compaction merges the runs with the level below them into a new sorted
level, which keeps the smallest identifier and the number of records of each digest.
A batch that comes later first probes the level's filter, and only what may be in the level is joined with it.
Digests that occur more than once are hits. A filter of them picks the texts of hits in the
scan, and the bytes of every hit are verified by grouping on the text itself before the group is believed.
All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def normalized(text):
    """Text with each stretch of ASCII white space replaced by one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def digest(text):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalized(text), 256))


class DigestIndex:
    """Runs (digest, doc_id) and a compacted level (digest, keep_id, n) with its filter, below ``path``.

    ``flush`` adds a batch as new runs, ``compact`` merges all runs into the level, ``lookup`` finds what the level
    has of a batch. They can be called in any order and number; every table is written once and never changed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.runs: list[DataFrame] = []
        self.level: DataFrame | None = None
        self.filter: common.BitFilter | None = None
        self.written = 0

    def _write(self, df: DataFrame, kind: str) -> DataFrame:
        path = f"{self.path}/{kind}-{self.written}"
        self.written += 1
        df.sortWithinPartitions("digest").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def flush(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Flush the documents as runs: one sorted file for each task."""
        self.runs.append(self._write(docs.select(digest(F.col(text_col)).alias("digest"), "doc_id"), "run"))
        return self.runs[-1]

    def compact(self) -> DataFrame:
        """Merge the runs into the level: the smallest identifier and the number of records of each digest. The runs are then done with."""
        parts = [run.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")) for run in self.runs]
        merged = self.level
        for part in parts:
            merged = part if merged is None else merged.unionByName(part)
        if parts:
            # equal digests of one task meet before the shuffle, so a huge group of copies moves few rows
            self.level = self._write(merged.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")), "level")
            self.runs, self.filter = [], None
        return self.level

    def lookup(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """doc_id, digest, keep_id, n of the documents whose digest the level has; the others give no row.

        Most others are ruled out by the filter before anything is shuffled. Flushed runs count only once they are compacted.
        """
        found = docs.select("doc_id", digest(F.col(text_col)).alias("digest"))
        if self.level is None:
            return found.select("*", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("n")).limit(0)
        if self.filter is None:
            self.filter = common.BitFilter(self.level.select("digest"), ["digest"], self.level.count(), "digest-filter")
        return self.filter.mark(found, F.col("digest")).filter("__maybe").drop("__maybe").join(self.level, "digest")


def _verified(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """digest, keep_id, n of the hits, from the texts themselves; it fails where different texts share a digest.

    All texts of a digest pass the filter together, so whatever else passes is a whole group as well, of one text.
    """
    picked = common.BitFilter(hits.select("digest"), ["digest"], hits.count(), "hit-filter")
    texts = docs.select("doc_id", normalized(F.col("text")).alias("t"))
    texts = picked.mark(texts, F.unhex(F.sha2("t", 256))).filter("__maybe")
    by_text = texts.groupBy("t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    by_digest = by_text.select(F.unhex(F.sha2("t", 256)).alias("digest"), "keep_id", "n").groupBy("digest")
    groups = by_digest.agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    sure = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")))
    return common.materialize(groups.select("digest", "keep_id", sure.alias("n")).filter("n > 1"), "digest-verified")


def exact_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space is normalised.
    Null text counts as empty, and all empty texts form one group. Of equal
    texts the smallest doc_id stays; null doc_ids come after all others, and a
    group with only null doc_ids keeps them. Rows that repeat a doc_id and a text share its decision.
    Texts of any length are treated alike. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text_col).alias("text"))
    index = DigestIndex(spark, common.new_path(spark, "digest-index"))
    run = index.flush(docs)
    groups = _verified(docs, index.compact().filter("n > 1"))
    marked = common.BitFilter(groups.select("digest"), ["digest"], groups.count(), "group-filter").mark(run, F.col("digest"))
    found = common.join_by_count(marked.filter("__maybe").drop("__maybe"), groups, "digest", "n", run.count(), "left")
    single = marked.filter("not __maybe").drop("__maybe").withColumns({"keep_id": F.lit(None).cast(dict(docs.dtypes)["doc_id"]), "n": F.lit(None).cast("long")})
    found = found.unionByName(single)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns.

    A decision belongs to a row's doc_id, which may be null, and its text. Of rows that repeat both, any one stays.
    """
    found = exact_duplicates(docs)
    if common.ids_are_unique(docs):
        gone = common.materialize(found.filter("not kept").select("doc_id"), "digest-decided")
        return common.drop_keys(docs, gone, "doc_id", "decided-filter")
    decided = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(
        F.first("kept").alias("__kept"), F.count(F.lit(1)).alias("__n")
    )
    decided = common.materialize(decided.filter("not __kept or __n > 1"), "digest-decided")
    again = decided.filter("__kept").select("__id", "__sha")
    marked = docs.withColumn("__text_sha", F.sha2(normalized(F.col("text")), 256))
    same_row = common.same(F.col("doc_id"), F.col("__id")) & (F.col("__text_sha") == F.col("__sha"))
    stays = marked.join(decided.select("__id", "__sha"), same_row, "left_anti")
    if not again.isEmpty():
        stays = stays.unionByName(marked.join(again, same_row, "left_semi").dropDuplicates(["doc_id", "__text_sha"]))
    return stays.drop("__text_sha")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
