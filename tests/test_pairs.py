"""Searches and pairs: what leaves a block, ties, and results that aren't shuffled pair by pair."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recallspark import staging
from recallspark.operators import contradiction, dedup, near, near_sets, scoring
from recallspark.sources.vectors import ListIndex


def counted(monkeypatch, name):
    """Counts of rows that are written under a name."""
    found, plain = [], staging.written

    def written(df, kind, by=None):
        rows = plain(df, kind, by)
        if kind == name:
            found.append(rows.count())
        return rows

    monkeypatch.setattr(staging, "written", written)
    return found


def test_nearest_leaves_few_of_each_block(spark, monkeypatch):
    """the same as all pairs with blocks of 16, of which about k for each query are compared whole; what is equal to nine places goes by id, and copies by the smaller id."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 8))
    data[100:160] = data[7]
    data[3] = data[4] * (1 + 1e-13) + 1e-14
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "id long, embedding array<double>").repartition(3)
    queries = rows.filter("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    monkeypatch.setattr(near, "WIDE", 16)
    most = counted(monkeypatch, "near-best")
    found = {}
    for r in sorted(scoring.nearest(rows, queries, 5, 0.05).collect(), key=lambda r: r.place):
        found.setdefault(r.query_id, []).append(r.id)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    s = np.round(unit[:20] @ unit.T, 9)
    assert found == {i: [int(j) for j in np.lexsort((np.arange(200), -s[i])) if s[i, j] >= 0.05][:5] for i in range(20)}
    assert most[-1] <= 20 * 5 * 2  # pairs compared whole, of 4,000


def test_lists_leave_few_of_each_block(spark, monkeypatch):
    """with all lists probed the index finds what all pairs give, and compares about k vectors for each query."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))], "id long, embedding array<double>").repartition(3)
    queries = rows.filter("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    centroids, members = scoring.index_lists(rows, 4)
    most = counted(monkeypatch, "near-best")
    found = scoring.nearest_in_lists(centroids, members, queries, 5, 4, 0.1)
    whole = scoring.nearest(rows, queries, 5, 0.1)
    assert sorted((r.query_id, r.place, r.id) for r in found.collect()) == sorted((r.query_id, r.place, r.id) for r in whole.collect())
    assert most[1] <= 20 * 5 * 2


def test_bytes_leave_few_of_each_block(spark, tmp_path, monkeypatch):
    """of the bytes of a block only what may be among the k best is given on."""
    rng = np.random.default_rng(6)
    data = rng.normal(size=(900, 8))
    rows = spark.createDataFrame([("a", i, [float(x) for x in v]) for i, v in enumerate(data)], "chat_id string, id long, embedding array<double>").repartition(3)
    index = ListIndex.create(rows, str(tmp_path / "i"), 3)
    queries = rows.filter("id < 30").select(F.col("id").alias("query_id"), "chat_id", F.col("embedding").alias("query_vector"))
    given = counted(monkeypatch, "by-bytes")
    found, _ = index.search(queries, 4, 1, exact=True)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.id)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert got == {i: [int(j) for j in np.argsort(-(unit[i] @ unit.T), kind="stable")[:4]] for i in range(30)}
    assert sum(given) <= 30 * 4 * 3 * 2  # of 27,000 pairs


def test_lists_of_opposite_memories(spark):
    """places leave out the memory itself, whose stored form is of another mind; a null name or place in the order, and no pair is grouped or sorted."""
    schema = "chat_id string, id long, ord long, type string, archived boolean, characters array<string>, summary string"
    bad, good = "They hate each other.", "They are friends."
    stored = [("a", i, None if i == 5 else 20 - i, "event", False, ["A", "b"] if i % 2 else ["c", "B", None], good) for i in range(6)]
    stored += [("a", 7, 1, "reflection", False, ["a", "b"], good), ("a", 8, 1, "event", True, ["a", "b"], good), ("a", 9, 1, "event", False, ["x", "y"], good), ("b", 1, 1, "event", None, ["a", "b"], good)]
    new = [("a", 3, 3, "event", False, ["a", "x"], bad), ("a", 4, 4, "event", False, ["C", "d"], bad), ("a", 6, 6, "event", False, ["a", "X"], bad), ("a", 10, 3, "event", False, ["b"], bad), ("a", 11, 3, "event", False, ["b", "a"], "Nothing.")]
    found = contradiction.against_new(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema))
    assert sorted((r.id, r.place, r.other) for r in found.collect()) == [(3, 1, 5), (3, 2, 9), (3, 3, 1), (4, 1, 2), (4, 2, 0), (6, 1, 5), (6, 2, 9), (6, 3, 3), (6, 4, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_words_of_review_pairs_are_made_once(spark):
    """pairs are made from written words, with the overlap of the plain definition; texts without words pair with nothing unless any overlap is asked for."""
    from recallspark.operators import dedup

    texts = ["red fox runs", "red fox sleeps", "the red, fox! runs", None, "лес", "blue whale"]
    mem = spark.createDataFrame([("a", i, "event", ["x"], i, i, t) for i, t in enumerate(texts)], "chat_id string, id long, type string, characters array<string>, message_id long, ord long, summary string")
    found = dedup.review_pairs(mem, low=0.25, high=0.9)
    assert sorted((r["first"], r["second"], round(r["overlap"], 3)) for r in found.collect()) == [(0, 1, 0.5), (0, 2, 0.75), (1, 2, 0.4)]
    assert dedup.review_pairs(mem, low=0.0, high=0.1).count() == 12
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_redirects_that_arrived_are_spread(spark):
    """chains that end at one node are no single task of the steps that follow."""
    from recallspark.operators import graph

    rows = spark.range(150_000).select(F.lit("a").alias("chat_id"), F.concat(F.lit("k"), "id").alias("from_key"), F.lit("hub").alias("to_key"))
    rows = rows.unionByName(spark.createDataFrame([("a", "x", "y"), ("a", "y", "k5"), ("a", "p", "q"), ("a", "q", "p")], rows.schema))
    found = graph.resolve_redirects(rows, 4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = graph.resolve_redirects(rows, 4).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in found.groupBy("task").count().collect()]
        ends = {r.from_key: r.to_key for r in found.filter("from_key in ('x', 'y', 'k7', 'p', 'q')").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert ends == {"x": "hub", "y": "hub", "k7": "hub", "p": "q", "q": "p"}
    assert sum(tasks) == 150_004 and max(tasks) < 75_000


def test_hashes_of_a_batch_go_by_parts(monkeypatch):
    """no more than SIDE texts are hashed side by side, whatever the batch, with the same hashes; also of no text."""
    import pandas as pd

    from recallspark.functions import codec

    texts = ["a" * i if i % 5 else None for i in range(1100)]
    whole, seen, plain = codec.hash53(texts), [], codec.hash53
    monkeypatch.setattr(codec, "hash53", lambda part: seen.append(len(part)) or plain(part))
    assert list(codec.text_hash.func(pd.Series(texts, index=range(5, 1105)))) == list(whole)
    assert seen == [512, 512, 76] and not len(codec.text_hash.func(pd.Series([], dtype=object)))


def test_edges_are_counted_by_numbers(spark):
    """no aggregate of the order graph's edges is keyed by text."""
    from recallspark.plans import tables

    plan = tables.graph(spark, "/root/testdata/sf0.001")[1]._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("], [")[0] for line in plan.split("\n") if "Aggregate [" in line]
    assert len(keys) == 2 and all("custkey" in k and "source" not in k for k in keys)


def test_similar_sets_leave_their_blocks_only_if_alike(spark, monkeypatch):
    """sets of very different sizes in many blocks, without a join of what they share; pairs are found whichever side is smaller, and unrelated ones of common words don't leave a block."""
    rng = random.Random(4)
    sets = [sorted({f"w{rng.randint(0, 150)}" for _ in range(rng.randint(1, 70))}) for _ in range(150)] + [[f"x{j}" for j in range(i)] for i in (3, 5, 6, 10, 300, 480, 500, 501)]
    sets += [sorted({w for w in a if rng.random() > 0.2} | {f"n{rng.randint(0, 99)}" for _ in a if rng.random() < 0.2}) or ["x"] for a in sets[:50]]
    df = spark.createDataFrame([("ab"[i % 2], f"k{i:03}", w) for i, w in enumerate(sets)] + [("a", "none", [])], "chat_id string, id string, words array<string>")
    monkeypatch.setattr(near_sets, "BLOCK", 8)
    least = counted(monkeypatch, "candidates")
    expected = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and i % 2 == j % 2 and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.key_candidates(df.selectExpr("chat_id", "id as l", "words as l_words"), None, 0.6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan
    one = {(int(r.l[1:]), int(r.r[1:])) for r in dedup.shared_word_candidates(df, None, 0.6).collect()}
    assert one == {(i, j) for i, j in expected if i < j} and len(one) > 30
    assert least[-1] <= 2 * len(one)
    two = {(int(r.l[1:]), int(r.r[1:])) for r in dedup.shared_word_candidates(df, df.filter("id < 'k180'"), 0.6).collect() if r.l != r.r}
    assert two == {(i, j) for i, j in expected if j < 180}


def test_long_signatures_are_folded(monkeypatch):
    """A set has the same signature of few bits whether it is made so or folded from one of many."""
    words = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)

    def made(bits):
        return np.packbits((np.bincount((words & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()

    assert near_sets._folded(pd.Series([made(1024), made(64)]), 8).tobytes() == made(64) * 2


def test_words_stay_where_copies_are_told(spark):
    """only copies are joined to the sets of words, which are not shuffled; of repeated rows none is lost or doubled."""
    mem = spark.createDataFrame([("a", 2, "one two"), ("a", 1, "two one"), ("a", 1, "two one"), ("b", 3, "one two"), ("a", 4, ""), ("a", 5, None), ("a", 6, "three")], "chat_id string, id long, summary string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes = dedup.word_classes(mem)
        plan = classes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted((r.chat_id, r.id, r.rep, len(r.words)) for r in classes.collect()) == [("a", 1, 1, 2), ("a", 1, 1, 2), ("a", 2, 1, 2), ("a", 4, 4, 0), ("a", 5, 5, 0), ("a", 6, 6, 1), ("b", 3, 3, 2)]


def test_words_are_shuffled_for_sets_and_not_for_pairs(spark, monkeypatch):
    """of a large group of near copies the words meet by blocks, once for each set, and not once for each of its pairs; a row that is there twice counts twice."""
    words = [[f"w{j}" for j in range(12)] + [f"v{i}", f"u{i % 7}"] for i in range(60)]
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate(words)] + [("a", 5, words[5]), ("a", 100, ["x"]), ("b", 1, words[1]), ("b", 2, words[1][:9])], "chat_id string, id long, words array<string>")
    monkeypatch.setattr(near_sets, "WORDY", 16)
    monkeypatch.setattr(near_sets, "CELLS", 1024)
    left, right = counted(monkeypatch, "alike-left"), counted(monkeypatch, "alike-right")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dedup.shared_word_candidates(df, None, 0.6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and left[-1] <= 62 and right[-1] <= 62
    expected = [("a", i, j, len(set(a) & set(b)) / len(set(a) | set(b))) for i, a in enumerate(words) for j, b in enumerate(words) if i < j for _ in range(2 if 5 in (i, j) else 1)]
    assert got == sorted(expected + [("b", 1, 2, 9 / 14)])
    events = df.select("chat_id", "id", F.array_join("words", " ").alias("summary"), F.col("id").alias("ord")).distinct()
    assert sorted(map(tuple, dedup.within_batch(events, 0.6).select("chat_id", "id").collect())) == [("a", 0), ("a", 100), ("b", 1)]
