"""The engine's tables, made from the given ones; whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging


#: Labels that are sent to the texts: a number and a mark each, about 50 MB in all.
MAX_LABELS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores where a table comes in fewer partitions than there are cores; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: a chat for each source, a clock that runs with doc_id."""
    d, i = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")), F.col("doc_id")
    # else texts are shuffled to meet their labels
    toxic = staging.small(read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("archived")), MAX_LABELS)
    return d.join(toxic, "doc_id", "left").select(
        F.coalesce("source", F.lit("none")).alias("chat_id"),
        i.alias("id"),
        F.when(i % 9 == 0, "reflection").otherwise("event").alias("type"),
        F.col("text").alias("summary"),
        (1 + i % 5).cast("int").alias("importance"),
        i.alias("extraction_count"),
        (i % 11 == 0).alias("is_transient"),
        (1 + i % 4).alias("mentions"),
        (i % 3).alias("retrieval_hits"),
        (1 + i % 3).cast("int").alias("level"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        F.array(F.concat(F.lit("c"), (i % 7).cast("string")), F.concat(F.lit("c"), (i % 5).cast("string"))).alias("characters"),
        (i * 1000).alias("sequence"),
        F.concat(F.lit("c"), (i % 7).cast("string")).alias("character"),
        i.alias("ord"),
    )


MEMORIES = """
mem AS (
  SELECT coalesce(d.source, 'none') AS chat_id, d.doc_id AS id, CASE WHEN d.doc_id % 9 = 0 THEN 'reflection' ELSE 'event' END AS type, d.text AS summary,
         1 + d.doc_id % 5 AS importance, d.doc_id AS extraction_count, d.doc_id % 11 = 0 AS is_transient, 1 + d.doc_id % 4 AS mentions,
         d.doc_id % 3 AS retrieval_hits, 1 + d.doc_id % 3 AS level, coalesce(l.toxic = 1, false) AS archived,
         ['c' || (d.doc_id % 7), 'c' || (d.doc_id % 5)] AS characters, d.doc_id * 1000 AS sequence, 'c' || (d.doc_id % 7) AS character, d.doc_id AS ord
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors of events: id, embedding, label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chat messages."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("idx"),
        F.col("text").alias("mes"),
        (F.col("role") == "user").alias("is_user"),
        (F.col("role") == "system").alias("is_system"),
        F.concat_ws(":", "conv_id", "turn").alias("fingerprint"),
        F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("n_tokens"),
    )


MESSAGES = """
msg AS (
  SELECT conv_id AS chat_id, turn AS idx, text AS mes, role = 'user' AS is_user, role = 'system' AS is_system, conv_id || ':' || turn AS fingerprint,
         CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS n_tokens
  FROM conversations
)"""


def edge_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Parts for what grows with the edges of the orders."""
    return staging.parts_of(read(spark, sf_dir, "lineitem").count(), spark)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the orders: customers, parts and nations; an edge's weight counts its occurrences."""
    customer, nation, orders, lineitem = (read(spark, sf_dir, t) for t in ("customer", "nation", "orders", "lineitem"))

    def key(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    people = customer.select(key("c", "c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("PERSON").alias("type"))
    things = read(spark, sf_dir, "part").select(key("p", "p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit("OBJECT").alias("type"))
    places = nation.select(key("n", "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("PLACE").alias("type"))
    # counted by numbers, which are a third of the keys' size; parts and nations have keys of their own, so the two tables of edges share none
    def counted(rows: DataFrame, source: str, prefix: str, target: str) -> DataFrame:
        edges = staging.dealt(rows.select(source, target), parts, source, target).groupBy(source, target).agg(F.count(F.lit(1)).alias("weight"))
        return edges.select(key("c", source).alias("source"), key(prefix, target).alias("target"), "weight")

    parts = edge_parts(spark, sf_dir)
    bought = staging.dealt(orders, parts, "o_orderkey").join(staging.dealt(lineitem, parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = counted(bought, "o_custkey", "p", "l_partkey").unionByName(counted(customer, "c_custkey", "n", "c_nationkey"))
    return people.unionByName(things).unionByName(places), edges


GRAPH = """
node AS (
  SELECT 'c' || c_custkey AS key, c_name AS name, 'PERSON' AS type FROM customer UNION ALL
  SELECT 'p' || p_partkey, p_name, 'OBJECT' FROM part UNION ALL SELECT 'n' || n_nationkey, n_name, 'PLACE' FROM nation
), edge AS (
  SELECT source, target, count(*) AS weight FROM (
    SELECT 'c' || o_custkey AS source, 'p' || l_partkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  ) GROUP BY source, target
)"""
