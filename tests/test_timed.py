"""The stateful processor of batches: restarts, late and repeated rows, chats that end."""

import pytest
from pyspark.sql import functions as F

from recallspark.streaming import batches, timed


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of a stateful query has a worker and a store of its own, which a few rows don't need."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "chat_id long, idx long, n_tokens long, is_user boolean, at timestamp, at_ms long"


def put(spark, folder, rows, n):
    """A file of messages (chat, idx, tokens, by the user, second)."""
    told = spark.createDataFrame(rows, "chat_id long, idx long, n_tokens long, is_user boolean, s long")
    told.select("chat_id", "idx", "n_tokens", "is_user", F.timestamp_seconds("s").alias("at"), (F.col("s") * 1000).alias("at_ms")).coalesce(1).write.parquet(f"{folder}/in/{n}")


def run(spark, folder, budget, idle=None):
    rows = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
    if idle is not None:
        rows = rows.withWatermark("at", "10 seconds")
    with timed.states(spark):
        batches.write_once(timed.micro_batches(rows, budget, idle), f"{folder}/out", f"{folder}/state").awaitTermination()
    return sorted(map(tuple, spark.read.schema(batches.OUTPUT).parquet(f"{folder}/out").collect()))


def chat(n, first=0, tokens=10, chat_id=1):
    return [(chat_id, i, tokens, i % 2 == 0, 1000 + i) for i in range(first, n)]


def test_restart_late_and_repeated_rows(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, [r for r in chat(9) if r[1] != 2], 1)
    assert run(spark, folder, 40) == [(1, 0, 0, 5, 5, 50)]
    put(spark, folder, chat(9) + chat(13, 9), 2)  # everything again, the late message and more; a new query from the checkpoint
    found = run(spark, folder, 40)
    assert found == [(1, 0, 0, 5, 5, 50), (1, 1, 2, 9, 5, 50)]
    put(spark, folder, chat(13), 3)
    assert run(spark, folder, 40) == found


def test_a_chat_that_falls_silent_ends(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, chat(4) + chat(3, chat_id=2), 1)
    assert run(spark, folder, 1000, 60_000) == []
    put(spark, folder, [(3, 0, 5, True, 5000)], 2)  # a message of another chat, much later, moves the watermark on
    run(spark, folder, 1000, 60_000)
    put(spark, folder, [(3, 1, 5, False, 5001)], 3)
    assert run(spark, folder, 1000, 60_000) == [(1, 0, 0, 3, 4, 40), (2, 0, 0, 2, 3, 30)]


def test_the_setting_comes_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError), timed.states(spark):
        raise ValueError
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
