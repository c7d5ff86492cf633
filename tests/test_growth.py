"""Steps whose cost grew faster than their tables: what they read, shuffle and put into one task."""

import math

import pytest
from pyspark.sql import functions as F

from recallspark import staging
from recallspark.operators import lexical, retrieval
from recallspark.plans import registry


def test_moods_are_told_of_chosen_memories_only(spark):
    texts = staging.written(spark.range(50).select(F.lit("a").alias("chat_id"), "id", F.array(F.lit("x"), F.lit("y")).alias("characters"), F.when(F.col("id") == 3, "They hate it").otherwise("They are friends").alias("summary")), "texts")
    rows = [(0, "a", i, i, float(-i), 3, "old", 10, i) for i in range(50)]
    scored = spark.createDataFrame(rows, "query_id int, chat_id string, id long, ord long, score double, importance int, bucket string, n_tokens int, extraction_count long")
    given = retrieval.select(scored, 50, texts=texts)
    assert sorted(r["id"] for r in given.collect()) == [0, 1, 2, 4]  # a newer one overrules the third
    assert not set(given.inputFiles()) & set(texts.inputFiles())


def test_asked_terms_are_sent_to_the_tokens(spark):
    told = staging.written(spark.range(40).select(F.lit("a").alias("chat_id"), "id", F.array(F.lit("xx"), F.lit("yy"), F.lit("xx")).alias("tokens"), F.lit(3).alias("dl")), "tokens")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posted = lexical.postings(told, spark.createDataFrame([("xx",), ("xx",), ("zz",)], "term string"))
        plan = posted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {tuple(r) for r in posted.select("term", "tf", "dl").collect()} == {("xx", 2, 3)} and posted.count() == 40


@pytest.mark.parametrize("share", [1, 2, 64])
def test_greatest_idf_where_no_term_is_alone(spark, monkeypatch, share):
    monkeypatch.setattr(lexical, "RARE_SHARE", share)
    rows = [("a", 1, ["x", "y", "y"]), ("a", 2, ["x", "y"]), ("a", 3, ["x"]), ("b", 1, ["x", "z"]), ("b", 2, ["x"]), ("c", 1, [])]
    told = spark.createDataFrame(rows, "chat_id string, id long, tokens array<string>").withColumn("dl", F.size("tokens"))
    found = {r["chat_id"]: r["max_idf"] for r in lexical.greatest_idf(told, lexical.corpus_size(told)).collect()}
    assert found == pytest.approx({"a": math.log(1.5 / 2.5 + 1), "b": math.log(1.5 / 1.5 + 1), "c": math.log(2)})


def test_trade_is_counted_by_nations(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(registry.communities, "detect", lambda edges: edges.select(F.col("a").alias("key"), F.col("b").alias("community"), "weight"))
    monkeypatch.setattr(registry.graph, "undirected", lambda edges: edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight"))
    kept = []
    monkeypatch.setattr(registry, "_chat", lambda df: kept.append(df) or df)
    registry.trade_communities(spark, "/root/testdata/sf0.001")
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "suppkey" in line]
    t = {n: f"'/root/testdata/sf0.001/{n}.parquet'" for n in ("lineitem", "orders", "customer", "supplier")}
    sql = f"SELECT 'b' || c_nationkey, 's' || s_nationkey, count(*) FROM {t['lineitem']} JOIN {t['orders']} ON l_orderkey = o_orderkey JOIN {t['customer']} ON o_custkey = c_custkey JOIN {t['supplier']} ON l_suppkey = s_suppkey GROUP BY ALL"
    assert sorted(tuple(r) for r in kept[0].select("source", "target", "weight").collect()) == sorted(duckdb.sql(sql).fetchall())


def test_merged_edges_are_dealt_by_their_number(spark, monkeypatch):
    chat = F.when(F.col("id") >= 0, "shop").alias("chat_id")
    edges = spark.range(60).select(chat, F.concat(F.lit("c"), (F.col("id") % 6).cast("string")).alias("source"), F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("target"), F.lit(1).alias("weight"))
    nodes = edges.select("chat_id", F.col("source").alias("key"), F.col("source").alias("name"), F.lit("t").alias("type"), F.lit("d").alias("description"), F.lit(1).alias("mentions"), F.array().cast("array<string>").alias("aliases")).distinct()
    merges = spark.createDataFrame([("shop", "c1", "c0"), ("shop", "p1", "p3")], "chat_id string, from_key string, to_key string")
    assert staging.parts_of(60, spark) is None and staging.parts_of(60, spark, 6) == 10
    few, many = (registry.graph.merge_nodes(nodes, edges, merges, parts)[1] for parts in (None, 10))
    plan = many._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("Exchange ")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([x for x in dealt if ", 10), REPARTITION_BY_NUM" in x]) == 3 and "hashpartitioning(chat_id" in dealt[0] and ", 10)" in dealt[0], plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.agg(F.sum("weight")).first()[0] == 60


def test_texts_are_not_shuffled_to_meet_their_labels(spark):
    """F2 to F4: labels are sent to the texts also where Spark would shuffle both."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.memories(spark, "/root/testdata/sf0.01").select("id", "summary", "archived")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
