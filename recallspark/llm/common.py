"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_code

#: ASCII white space as the operators' contracts define it: blank and \t..\r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that setting is
    absent in a local session (tests) is a temporary folder made and set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="recallspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never used twice."""
    return f"{shared_dir(spark)}/recallspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before the table, and no copy lives on one machine only.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left, right):
    """Null-safe equality of two columns."""
    return left.eqNullSafe(right)


def prefix_sum(df: DataFrame, group: str, order: list, value: str, out: str, bucket_rows: int, rows: int) -> DataFrame:
    """Exclusive running sum of ``value`` in each ``group``, without a window over a whole group.

    ``order`` names two columns: a uniform unsigned 32-bit long (the bucket key)
    and a tie-breaker. The 32-bit range is cut into about ``rows / bucket_rows``
    ranges, and windows run inside a range, over the ranges of a stretch of
    1,024, and over the stretches. So a group that holds most of the rows is
    still spread over many tasks.
    """
    key, tie = order
    n = max(1, -(-rows // max(1, bucket_rows)))
    fine = (F.col(key) * F.lit(n) / F.lit(1 << 32)).cast("long")
    marked = df.withColumn("__fine", fine).withColumn("__coarse", (F.col("__fine") / 1024).cast("long"))
    before = (Window.unboundedPreceding, -1)
    sums = marked.groupBy(group, "__coarse", "__fine").agg(F.sum(value).alias("__v"))
    in_coarse = Window.partitionBy(group, "__coarse").orderBy("__fine").rowsBetween(*before)
    fine_off = sums.withColumn("__fo", F.coalesce(F.sum("__v").over(in_coarse), F.lit(0)))
    coarse = sums.groupBy(group, "__coarse").agg(F.sum("__v").alias("__v"))
    in_group = Window.partitionBy(group).orderBy("__coarse").rowsBetween(*before)
    coarse_off = coarse.select(group, "__coarse", F.coalesce(F.sum("__v").over(in_group), F.lit(0)).alias("__co"))
    offsets = fine_off.join(coarse_off, [group, "__coarse"]).select(
        F.col(group).alias("__g"), F.col("__fine").alias("__f"), (F.col("__fo") + F.col("__co")).alias("__off")
    )
    in_fine = Window.partitionBy(group, "__fine").orderBy(key, tie).rowsBetween(*before)
    local = marked.withColumn("__local", F.coalesce(F.sum(value).over(in_fine), F.lit(0)))
    joined = local.join(offsets, (F.col(group) == F.col("__g")) & (F.col("__fine") == F.col("__f")))
    return joined.withColumn(out, F.col("__local") + F.col("__off")).drop("__local", "__off", "__g", "__f", "__fine", "__coarse")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1024


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the workers.

    Rows bear whole texts, so a session that has Spark's own number of rows in a batch gets BATCH_ROWS instead; one that was set is kept. A
    worker gives back its spare Arrow memory after each part, as it lives on for later stages.
    """
    spark = df.sparkSession
    ship_code(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))

    def run(parts):
        import pyarrow

        yield from function(parts)
        pyarrow.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


@contextmanager
def rows_at_a_time(spark: SparkSession, rows: int):
    """Within it, Python workers get ``rows`` rows at a time: for rows that are large by themselves. What is run within it must be written within it."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Keys up to this number are sent to every task; more are filtered by bits first.
BROADCAST_KEYS = 500_000
#: Bits of a filter at most, 32 MB; and bits for each key where that allows it.
FILTER_BITS, BITS_PER_KEY = 1 << 28, 32
_BLOCK_BITS = 32_768  # of a bitmap as bitmap_construct_agg makes it


class BitFilter:
    """A Bloom filter with one hash of a set of keys, as a table of bitmaps (block, bits) of 4 KB each.

    Its size is bounded by FILTER_BITS however many keys there are, so it can be sent to every task. Keys in the set
    always pass; others pass with a chance of about keys / bits, so what passes is to be checked exactly.
    """

    def __init__(self, keys: DataFrame, columns: list[str], count: int, name: str):
        bits = _BLOCK_BITS
        while bits < min(FILTER_BITS, count * BITS_PER_KEY):
            bits *= 2
        self.bits = bits
        place = keys.select(self._place([F.col(c) for c in columns]).alias("p"))
        made = place.groupBy(F.expr(f"p div {_BLOCK_BITS}").alias("__block")).agg(F.expr(f"bitmap_construct_agg(p % {_BLOCK_BITS})").alias("__bitmap"))
        self.table = materialize(made, name)

    def _place(self, columns: list):
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits)).cast("long")

    def mark(self, df: DataFrame, *columns, out: str = "__maybe") -> DataFrame:
        """``df`` with a boolean column: whether the key may be in the set."""
        marked = df.withColumn("__place", self._place(list(columns))).withColumn("__b", F.expr(f"__place div {_BLOCK_BITS}"))
        met = marked.join(F.broadcast(self.table), F.col("__b") == F.col("__block"), "left")
        byte = F.conv(F.hex(F.substr("__bitmap", F.expr(f"cast(__place % {_BLOCK_BITS} div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
        bit = F.expr("shiftright({0}, cast(__place % 8 as int)) & 1 = 1".format("__byte"))
        return met.withColumn("__byte", F.coalesce(byte, F.lit(0))).withColumn(out, bit).drop("__place", "__b", "__block", "__bitmap", "__byte")


def keep_keys(df: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among the non-null values of the one column of ``keys``, a written table that may repeat them.

    Few keys are sent to every task. Otherwise a bit filter drops most other rows in the scan, and only what it lets through is shuffled to meet the keys.
    """
    keys = keys.toDF("__key").filter("__key is not null")
    n = keys.count()
    if n <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), F.col(column) == F.col("__key"), "left_semi")
    maybe = BitFilter(keys, ["__key"], n, name).mark(df, F.col(column)).filter("__maybe").drop("__maybe")
    return maybe.join(keys, F.col(column) == F.col("__key"), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """The other rows: those whose ``column`` is null or not among the values of ``keys``. Rows that the bit filter lets through aren't shuffled."""
    keys = keys.toDF("__key").filter("__key is not null")
    n = keys.count()
    if n <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), F.col(column) == F.col("__key"), "left_anti")
    marked = BitFilter(keys, ["__key"], n, name).mark(df, F.col(column))
    sure = marked.filter("not __maybe")
    return sure.unionByName(marked.filter("__maybe").join(keys, F.col(column) == F.col("__key"), "left_anti")).drop("__maybe")


#: Rows of one key that a task may get in a join by that key before the key counts as hot, at least; and hot keys at most.
HOT_ROWS, HOT_KEYS = 256, 100_000


def join_by_count(df: DataFrame, keys: DataFrame, key: str, count: str, rows: int, how: str = "inner") -> DataFrame:
    """``df`` of ``rows`` rows joined with ``keys``, which has one small row for each key and in ``count`` how many rows of ``df`` bear it.

    Keys with over rows / HOT_KEYS rows can't be more than HOT_KEYS; these are sent to every task, so that their rows stay where they are.
    The other rows are shuffled by the key; with ``how`` "left" they stay if they have no match. Hot keys are looked up
    by a 64-bit hash, which takes far less room on an executor than other types of keys, and then compared themselves.
    """
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    told = [c for c in keys.columns if c != key]
    hot = keys.filter(F.col(count) > limit).select(F.xxhash64(key).alias("__h"), F.col(key).alias("__hot"), *told)
    met = df.withColumn("__h", F.xxhash64(key)).join(F.broadcast(hot), "__h", "left")
    is_hot = F.coalesce(F.col("__hot") == F.col(key), F.lit(False))
    rest = met.filter(~is_hot).select(*df.columns).join(keys.filter(F.col(count) <= limit), key, how)
    return met.filter(is_hot).select(*df.columns, *told).unionByName(rest)


def salted_join(df: DataFrame, payload: DataFrame, key: str, counts: DataFrame, by: str) -> DataFrame:
    """``df``, which has a column ``c``, joined with ``payload``, which has one row for each key, by shuffling both.

    ``counts`` (key, c) and the column ``c`` tell how many rows of ``df`` a key has. These are dealt by a hash of ``by`` to as many salts as
    give about HOT_ROWS rows each, and the payload is repeated for each salt. So it may be large, and no key fills a task. Both sides
    are shuffled however small they are, so that the plan is the same at every size.
    """
    salts = F.ceil(F.col("c") / HOT_ROWS).cast("int")
    left = df.withColumn("__salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    right = payload.join(counts, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("c")
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def small(df: DataFrame) -> DataFrame:
    """A table that is sent to every task if it has at most BROADCAST_KEYS rows; it is counted to know."""
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def ids_are_unique(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own; only the ids are shuffled."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty()
