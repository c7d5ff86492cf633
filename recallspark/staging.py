"""Where intermediate tables are kept: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="recallspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/recallspark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: a lost executor costs its tasks, not the stages before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that later steps read the columns and rows they need only."""
    path = new_path(df.sparkSession, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table that is sent to every task if it has at most ``limit`` rows, which are counted; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dealt(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """The rows dealt by a hash of columns into ``parts``, more than Spark would take; as they are with None."""
    return df if parts is None else df.repartition(parts, *columns)


def parts_of(rows: int, spark: SparkSession, each: int = 1_000_000) -> int | None:
    """Parts that keep a task at about ``each`` rows, so that its memory doesn't grow with the input; None where Spark's own number does."""
    parts = -(-rows // each)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
