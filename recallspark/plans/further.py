"""More registered queries: the store's changes, the graph, dedup, scheduling, reports and retrieval as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import language, text, tokens
from .. import staging
from ..operators import blockmax, communities, context, contradiction, dedup, graph, lexical, maintenance, ranking, reports, retrieval, scheduling, scoring, selection, statistics
from ..sources import vectors as vector_store
from .registry import ORACLES, _BALANCE, _BM25, _CORPUS, _DECAY, _FAST, _ITEMS, _bucketed, _distance, _mood_sql, _vectors, query, rounded
from .tables import GRAPH, MEMORIES, MESSAGES, memories, messages, read, vectors
from .tables import graph as graph_tables

_LOG = f"{MESSAGES}, log AS (SELECT * FROM msg WHERE NOT is_system)"


# ---- changes of the store


@query(f"""WITH {MEMORIES} SELECT chat_id, id, CASE WHEN id % 5 = 0 THEN 'new ' || id ELSE summary END AS summary, CASE WHEN id % 5 = 0 AND id % 10 = 0 THEN 4 ELSE importance END::BIGINT AS importance,
id % 5 = 0 AS stale FROM mem""")
def update_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth memory with another summary, every tenth with another importance; a changed summary loses its vector."""
    mem = memories(spark, sf_dir).withColumn("embedding", F.array(F.lit(1.0)))
    changes = mem.filter("id % 5 = 0").select("chat_id", "id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("summary"), F.when(F.col("id") % 10 == 0, 4).alias("importance"))
    rows = maintenance.update(mem, changes, ["summary", "importance"])
    return rows.select("chat_id", "id", "summary", F.col("importance").cast("long").alias("importance"), F.col("embedding").isNull().alias("stale"))


@query(f"WITH {MEMORIES} SELECT chat_id, id, id % 3 = 0 OR archived AS archived FROM mem")
def archive_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = memories(spark, sf_dir)
    return maintenance.archive(mem, mem.filter("id % 3 = 0").select("chat_id", "id")).select("chat_id", "id", "archived")


@query(f"""WITH {MEMORIES}, one AS (SELECT min(chat_id) AS c FROM mem)
SELECT chat_id, id, array_to_string(CASE WHEN chat_id = c THEN list_filter(characters, lambda x: x <> 'c1') ELSE characters END, ',') AS characters FROM mem, one""")
def forget_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chat's memories without c1 in their lists."""
    mem = memories(spark, sf_dir)
    chat = mem.agg(F.min("chat_id")).first()[0]
    return maintenance.forget_character(mem, chat or "", "c1").select("chat_id", "id", F.array_join("characters", ",").alias("characters"))


@query(f"""WITH {MESSAGES}, c AS (SELECT chat_id, 5 AS n FROM msg WHERE chat_id % 2 = 0 GROUP BY chat_id), d AS (SELECT chat_id, count(*) AS m FROM msg WHERE idx % 2 = 0 GROUP BY chat_id)
SELECT coalesce(c.chat_id, d.chat_id) AS chat_id, coalesce(n, 0) + coalesce(m, 0) AS count FROM c FULL JOIN d ON d.chat_id = c.chat_id""")
def advance_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks of the even chats, moved on by every second message of all chats."""
    log = messages(spark, sf_dir)
    clock = log.filter("chat_id % 2 = 0").select("chat_id").distinct().withColumn("count", F.lit(5).cast("long"))
    return maintenance.advance(clock, log.filter("idx % 2 = 0"))


@query(f"""WITH {MEMORIES}, p AS (SELECT a.chat_id, a.id AS older, b.id AS newer, a.importance AS i FROM mem a JOIN mem b ON a.chat_id = b.chat_id AND b.id = a.id + 7 WHERE a.id % 14 = 0)
SELECT m.chat_id, m.id, coalesce('merged ' || n.older, m.summary) AS summary, greatest(m.importance, coalesce(n.i, 0))::BIGINT AS importance, m.archived OR o.newer IS NOT NULL AS archived,
       o.newer AS merged_into FROM mem m LEFT JOIN p n ON n.chat_id = m.chat_id AND n.newer = m.id LEFT JOIN p o ON o.chat_id = m.chat_id AND o.older = m.id""")
def merge_contradicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories seven ids apart, of which the older one is archived and the newer one takes a merged summary."""
    mem = memories(spark, sf_dir)
    pairs = mem.filter("id % 14 = 0").select("chat_id", F.col("id").alias("older"), (F.col("id") + 7).alias("newer"), F.concat(F.lit("merged "), F.col("id").cast("string")).alias("summary"))
    pairs = pairs.join(mem.select("chat_id", F.col("id").alias("newer")), ["chat_id", "newer"], "left_semi")
    rows = maintenance.merge_contradicting(mem, pairs)
    return rows.select("chat_id", "id", "summary", F.col("importance").cast("long").alias("importance"), "archived", "merged_into")


@query(f"""WITH {MEMORIES} SELECT chat_id, id, array_to_string(list_transform(characters, lambda c: CASE WHEN c IN ('c1', 'c3') THEN upper(c) ELSE c END), ',') AS characters FROM mem
WHERE characters[1] <> characters[2] UNION ALL SELECT chat_id, id, CASE WHEN characters[1] IN ('c1', 'c3') THEN upper(characters[1]) ELSE characters[1] END FROM mem WHERE characters[1] = characters[2]""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters written as the chat's list of names writes them, each once."""
    mem = memories(spark, sf_dir)
    names = mem.select("chat_id").distinct().select("chat_id", F.explode(F.array(F.lit("C1"), F.lit("C3"))).alias("name"))
    return maintenance.canonical_names(mem, names).select("chat_id", "id", F.array_join("characters", ",").alias("characters"))


@query(f"WITH {MEMORIES} SELECT chat_id, id, retrieval_hits + (id % 4 = 0)::INT + (id % 8 = 0)::INT AS retrieval_hits FROM mem")
def count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of memories that one query was given (every fourth) or two (every eighth)."""
    mem = memories(spark, sf_dir)
    given = mem.filter("id % 4 = 0").select("chat_id", "id", F.lit(0).alias("query_id")).unionByName(mem.filter("id % 8 = 0").select("chat_id", "id", F.lit(1).alias("query_id")))
    return retrieval.count_hits(mem, given).select("chat_id", "id", "retrieval_hits")


@query(f"""WITH {MESSAGES} SELECT chat_id, 'event_' || chat_id || '_' || idx AS id, greatest(0, idx - 1) * 1000 + idx AS sequence, CASE WHEN idx % 2 = 0 THEN 'u' ELSE 'a' END AS witnesses,
CASE WHEN idx % 3 = 0 THEN 3 ELSE idx % 3 END::BIGINT AS importance, coalesce(is_user, false) AS is_transient FROM msg""")
def enrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as new events with what they lack filled in."""
    i = F.col("idx")
    rows = messages(spark, sf_dir).select(
        "chat_id", F.col("chat_id").cast("string").alias("batch_id"), i.alias("n"), F.array(F.greatest(F.lit(0), i - 1), i).alias("message_ids"), (i % 3).alias("importance"),
        F.when(i % 2 == 0, F.array(F.lit("u"))).alias("characters"), F.when(i % 2 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("witnesses"), F.when(F.col("is_user"), True).alias("is_transient"),
    )
    done = maintenance.enrich_events(rows)
    return done.select("chat_id", "id", "sequence", F.array_join("witnesses", ",").alias("witnesses"), F.col("importance").cast("long").alias("importance"), "is_transient")


@query(f"WITH {MESSAGES} SELECT chat_id, idx, is_system OR idx % 2 = 1 AS is_system, idx % 2 = 1 AND NOT is_system AS hidden FROM msg")
def hide_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with every second one processed and hidden."""
    log = messages(spark, sf_dir)
    done = log.filter("idx % 2 = 1").select("chat_id", "fingerprint")
    return maintenance.hide_processed(log, maintenance.mark_processed(done, done)).select("chat_id", "idx", "is_system", "hidden")


_PAIRS = """pr AS (SELECT a.chat_id, a.id AS first, b.id AS second, CASE a.id // 10 % 4 WHEN 0 THEN 'keep-a' WHEN 1 THEN 'keep-b' WHEN 2 THEN 'skip' ELSE 'merge' END AS action
  FROM mem a JOIN mem b ON a.chat_id = b.chat_id AND b.id = a.id + 5 WHERE a.id % 10 = 0)"""


@query(f"""WITH {MEMORIES}, {_PAIRS}, gone AS (SELECT chat_id, CASE WHEN action = 'keep-a' THEN second ELSE first END AS id FROM pr WHERE action LIKE 'keep%')
SELECT m.chat_id, m.id, m.mentions + coalesce(s.mentions, 0) AS mentions, CASE WHEN length(s.summary) > 0 THEN m.summary || ' (also: ' || s.summary || ')' ELSE m.summary END AS summary,
       array_to_string(list_sort(CASE WHEN s.id IS NULL THEN m.characters ELSE list_distinct(m.characters || s.characters) END), ',') AS characters, r.chat_id IS NOT NULL AS reviewed
FROM mem m LEFT JOIN pr ON pr.chat_id = m.chat_id AND pr.second = m.id AND action = 'merge' LEFT JOIN mem s ON s.chat_id = pr.chat_id AND s.id = pr.first
LEFT JOIN (SELECT chat_id, first AS id FROM pr WHERE action IN ('skip', 'merge') UNION SELECT chat_id, second FROM pr WHERE action IN ('skip', 'merge')) r ON r.chat_id = m.chat_id AND r.id = m.id
WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.chat_id = m.chat_id AND gone.id = m.id)""")
def settle_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories after decisions on pairs five ids apart: keep one, skip, or merge."""
    mem = memories(spark, sf_dir)
    action = F.element_at(F.array(*[F.lit(a) for a in ("keep-a", "keep-b", "skip", "merge")]), (F.floor(F.col("id") / 10) % 4 + 1).cast("int"))
    pairs = mem.filter("id % 10 = 0").select("chat_id", F.col("id").alias("first"), (F.col("id") + 5).alias("second"), action.alias("action"))
    pairs = pairs.join(mem.select("chat_id", F.col("id").alias("second")), ["chat_id", "second"], "left_semi")
    rows = maintenance.settle_duplicates(mem, pairs)
    return rows.select("chat_id", "id", "mentions", "summary", F.array_join(F.array_sort("characters"), ",").alias("characters"), "reviewed")


@query(f"""WITH {MEMORIES} SELECT chat_id, id, CASE WHEN id % 3 = 0 THEN 'second' ELSE 'first' END AS told, CASE WHEN id % 2 = 0 THEN ord ELSE 1000000 + ord END AS ord FROM mem WHERE id % 2 = 0 OR id % 3 = 0""")
def union_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even memories and those divisible by three: the second table's row counts, at the first one's place."""
    mem = memories(spark, sf_dir).select("chat_id", "id", "ord")
    first, second = mem.filter("id % 2 = 0").withColumn("told", F.lit("first")), mem.filter("id % 3 = 0").withColumn("told", F.lit("second")).withColumn("ord", F.col("ord") + 1_000_000)
    return maintenance.union_last(first, second).select("chat_id", "id", "told", "ord")


@query(f"""WITH {MEMORIES}, s AS (SELECT DISTINCT chat_id, unnest(['c1', 'C2', 'x', 'Ann', 'АНН', 'Бен']) AS character FROM mem),
k AS (SELECT chat_id, unnest(characters) AS n FROM mem UNION SELECT DISTINCT chat_id, 'ann' FROM mem)
SELECT DISTINCT s.chat_id, s.character FROM s JOIN k ON k.chat_id = s.chat_id AND (lower(s.character) = k.n OR (s.character = 'АНН' AND k.n = 'ann'))""")
def valid_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of characters that some memory or the list of names knows, in either script."""
    mem = memories(spark, sf_dir)
    chats = mem.select("chat_id").distinct()
    states = chats.select("chat_id", F.explode(F.array(*[F.lit(n) for n in ("c1", "C2", "x", "Ann", "АНН", "Бен")])).alias("character"))
    return maintenance.valid_states(states, chats.withColumn("name", F.lit("Ann")), mem)


@query(f"""WITH {MEMORIES}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY sequence DESC, ord DESC) AS k FROM mem WHERE NOT is_transient)
SELECT m.chat_id, m.id, CASE WHEN r.k <= 50 THEN m.id % 2 = 0 ELSE m.is_transient END AS is_transient FROM mem m LEFT JOIN r ON r.chat_id = m.chat_id AND r.id = m.id""")
def judge_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest lasting memories of each chat, every second of which is judged to be transient."""
    mem = memories(spark, sf_dir)
    judged = maintenance.last_to_judge(mem).select("chat_id", "id", (F.col("id") % 2 == 0).alias("is_transient"))
    return maintenance.apply_judgement(mem, judged).select("chat_id", "id", "is_transient")


@query(f"""WITH {MEMORIES} SELECT chat_id, id, CASE WHEN archived THEN 'delete' ELSE 'sync' END AS op FROM mem WHERE (archived AND id % 2 = 0) OR (NOT archived AND id % 2 <> 0 AND id % 3 <> 0)""")
def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outside index that has the even memories must be told; every third has no vector."""
    mem = memories(spark, sf_dir).withColumns({"synced": F.col("id") % 2 == 0, "embedding": F.when(F.col("id") % 3 != 0, F.array(F.lit(1.0)))})
    return maintenance.sync_changes(mem).select("chat_id", "id", "op")


@query(f"""WITH {MEMORIES} SELECT 'memory' AS kind, chat_id, id::VARCHAR AS id, summary AS text FROM mem WHERE id % 2 = 0 AND length(trim(summary)) > 0
UNION ALL SELECT 'node', 'shop', 'p' || p_partkey, p_name FROM part WHERE p_partkey % 2 = 0""")
def without_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories and nodes that still need a vector."""
    mem = memories(spark, sf_dir).withColumn("embedding", F.when(F.col("id") % 2 != 0, F.array(F.lit(1.0))))
    k = F.col("p_partkey")
    nodes = read(spark, sf_dir, "part").select(F.lit("shop").alias("chat_id"), F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(k % 2 != 0, F.array(F.lit(1.0))).alias("embedding"))
    return maintenance.without_vector(("memory", mem, "summary"), ("node", nodes, "name"))


# ---- scheduling


@query(f"""WITH {_LOG}, t AS (SELECT *, NOT is_user AND coalesce(lead(is_user) OVER (PARTITION BY chat_id ORDER BY idx), true) AS b FROM log),
s AS (SELECT *, sum(b::INT) OVER (PARTITION BY chat_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS k FROM t) SELECT chat_id, idx FROM s WHERE k > 1""")
def trim_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chat without its last turn."""
    return scheduling.without_last_turns(messages(spark, sf_dir), 1).select("chat_id", "idx")


@query(f"""WITH {MESSAGES}, n AS (SELECT *, sum((NOT is_user AND NOT is_system)::INT) OVER (PARTITION BY chat_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n FROM msg)
SELECT chat_id, min(idx) AS frozen_until FROM n WHERE n >= 2 GROUP BY chat_id""")
def frozen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message with each chat's second answer."""
    return scheduling.frozen_prefix(messages(spark, sf_dir), 2)


@query(f"""WITH {MESSAGES}, n AS (SELECT *, sum((NOT is_user AND NOT is_system)::INT) OVER (PARTITION BY chat_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n FROM msg),
f AS (SELECT chat_id, min(idx) AS f FROM n WHERE n >= 1 GROUP BY chat_id), log AS (SELECT msg.* FROM msg JOIN f ON f.chat_id = msg.chat_id WHERE idx > f AND NOT is_system),
w AS (SELECT *, sum(n_tokens) OVER (PARTITION BY chat_id) - 60 AS et, count(*) OVER (PARTITION BY chat_id) - 2 AS er,
  coalesce(sum(n_tokens) OVER (PARTITION BY chat_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bt,
  count(*) OVER (PARTITION BY chat_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS br FROM log)
SELECT chat_id, idx, n_tokens FROM w WHERE bt < et OR br < er""")
def auto_hide_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be hidden of each chat behind its first answer, which stays."""
    return scheduling.to_hide(messages(spark, sf_dir), 60, 2, frozen_answers=1)


@query(f"""WITH {MESSAGES}, p AS (SELECT chat_id, count(*) AS total, count(*) FILTER (is_system) AS hidden, count(*) FILTER (NOT is_system AND idx % 2 = 0) AS extracted FROM msg GROUP BY chat_id),
q AS (SELECT *, greatest(0, total - 1) AS extractable, greatest(0, greatest(0, total - 1) - extracted) AS unextracted FROM p)
SELECT *, unextracted % 3 AS in_batch, CASE WHEN unextracted % 3 = 0 AND unextracted > 0 THEN 0 ELSE 3 - unextracted % 3 END AS needed FROM q""")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far extraction is in batches of three messages, one held back, where every second message is done."""
    log = messages(spark, sf_dir)
    return reports.extraction_stats(log, log.filter("idx % 2 = 0").select("chat_id", "fingerprint").unionByName(log.select("chat_id", F.lit("gone").alias("fingerprint"))), 3, 1)


@query(f"""WITH {_LOG}, p AS (SELECT chat_id, sum(n_tokens)::BIGINT AS visible, coalesce(sum(n_tokens) FILTER (idx % 2 <> 0), 0)::BIGINT AS waiting FROM log GROUP BY chat_id)
SELECT *, least(100, floor(100 * visible / 500.0 + 0.5))::BIGINT AS visible_percent, least(100, floor(100 * waiting / 150.0 + 0.5))::BIGINT AS waiting_percent FROM p""")
def budget_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each chat shows and that wait, against 500 and 150."""
    log = messages(spark, sf_dir)
    return reports.budget_use(log, log.filter("idx % 2 = 0"), 500, 150)


@query(f"""WITH {MESSAGES} SELECT chat_id, idx FROM msg WHERE idx % 3 = 0""")
def compressed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that stand for others, told by their further fields."""
    log = messages(spark, sf_dir)
    said = F.struct(F.col("mes"), F.col("is_user"))
    listed = F.to_json(F.struct(F.lit("x").alias("kind"), F.array(said).alias("range")))
    other = F.to_json(F.struct(F.lit("[]").alias("range"), F.array(F.struct(F.col("idx"))).alias("more")))
    extra = F.when(F.col("idx") % 3 == 0, listed).when(F.col("idx") % 3 == 1, other)
    return log.filter(scheduling.stands_for_others(extra)).select("chat_id", "idx")


# ---- graph


_ORDERS = """ord AS (SELECT o_orderkey AS ord, 'Customer ' || (o_custkey % 40) AS name, o_orderpriority AS description FROM orders)"""


@query(f"""WITH RECURSIVE {_ORDERS}, d AS (SELECT name, description, min(ord) AS ord, count(*) AS n FROM ord GROUP BY ALL), m AS (SELECT lower(name) AS key, min_by(name, ord) AS name, sum(n) AS mentions FROM d GROUP BY lower(name)),
s AS (SELECT lower(name) AS key, description, row_number() OVER (PARTITION BY lower(name) ORDER BY ord DESC) AS back FROM d),
l AS (SELECT key, list(description ORDER BY back) AS all_ FROM s GROUP BY key)
SELECT m.key, m.name, 'PERSON' AS type, m.mentions::BIGINT AS mentions, array_to_string(list_reverse(all_[1:3]), ' | ') AS description FROM m JOIN l ON l.key = m.key""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes with their orders' priorities as descriptions: each once, the last three stay."""
    o = read(spark, sf_dir, "orders").select(
        F.lit("shop").alias("chat_id"), F.concat(F.lit("Customer "), (F.col("o_custkey") % 40).cast("string")).alias("name"), F.lit("PERSON").alias("type"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("ord")
    )
    none = spark.createDataFrame([], "chat_id string, key string, name string, type string, description string, mentions long")
    return graph.upsert_nodes(none, o).select("key", "name", "type", "mentions", "description")


@query(f"""WITH {GRAPH}, red AS (SELECT 'c' || c_custkey AS f, 'c' || (c_custkey - 1) AS t FROM customer WHERE c_custkey % 10 = 2),
said AS (SELECT 'c' || o_custkey AS s, 'c' || (o_custkey % 50 + 1) AS g FROM orders WHERE o_orderkey % 3 = 0),
r AS (SELECT coalesce(a.t, s) AS s, coalesce(b.t, g) AS g FROM said LEFT JOIN red a ON a.f = s LEFT JOIN red b ON b.f = g),
n AS (SELECT s AS source, g AS target, count(*) AS n FROM r WHERE s <> g AND s IN (SELECT key FROM node) AND g IN (SELECT key FROM node) GROUP BY ALL),
old AS (SELECT source, target, weight FROM edge WHERE target LIKE 'n%')
SELECT coalesce(old.source, n.source) AS source, coalesce(old.target, n.target) AS target, (coalesce(weight, 0) + coalesce(n, 0))::BIGINT AS weight
FROM old FULL JOIN n ON n.source = old.source AND n.target = old.target""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between customers counted into the graph, over redirects, without self loops."""
    nodes, edges = graph_tables(spark, sf_dir)
    c = F.col("c_custkey")
    redirects = read(spark, sf_dir, "customer").filter("c_custkey % 10 = 2").select(F.lit("shop").alias("chat_id"), F.concat(F.lit("c"), c.cast("string")).alias("from_key"), F.concat(F.lit("c"), (c - 1).cast("string")).alias("to_key"))
    said = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(
        F.lit("shop").alias("chat_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("c"), (F.col("o_custkey") % 50 + 1).cast("string")).alias("target"),
        F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("ord"),
    )
    old = edges.filter("target like 'n%'").select(F.lit("shop").alias("chat_id"), "source", "target", "weight", F.lit("").alias("description"))
    return graph.upsert_edges(old, said, nodes.withColumn("chat_id", F.lit("shop")), redirects).select("source", "target", "weight")


@query(f"""WITH {GRAPH}, e AS (SELECT CASE WHEN source = 'c1' THEN 'first buyer' ELSE source END AS source, CASE WHEN target = 'c1' THEN 'first buyer' ELSE target END AS target, weight FROM edge)
SELECT source, target, weight FROM e""")
def rename_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges after the first customer got another name."""
    nodes, edges = (df.withColumn("chat_id", F.lit("shop")) for df in graph_tables(spark, sf_dir))
    return graph.rename(nodes, edges, "shop", "c1", "First  Buyer")[1].select("source", "target", "weight")


@query(f"WITH {GRAPH} SELECT source, target, weight FROM edge WHERE NOT regexp_matches(source, '^c[0-9]*0$') AND NOT regexp_matches(target, '^c[0-9]*0$')")
def delete_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after every tenth customer is deleted."""
    nodes, edges = (df.withColumn("chat_id", F.lit("shop")) for df in graph_tables(spark, sf_dir))
    none = spark.createDataFrame([], "chat_id string, from_key string, to_key string")
    return graph.delete_nodes(nodes, edges, none, nodes.filter("key rlike '^c[0-9]*0$'").select("chat_id", "key"))[1].select("source", "target", "weight")


@query(f"WITH {GRAPH} SELECT source, target FROM edge WHERE target NOT LIKE 'n%'")
def proper_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between known nodes, where nations aren't known."""
    nodes, edges = (df.withColumn("chat_id", F.lit("shop")) for df in graph_tables(spark, sf_dir))
    return graph.proper_edges(edges, nodes.filter("type <> 'PLACE'")).select("source", "target")


@query(f"""WITH {GRAPH}, k AS (SELECT key FROM node WHERE lower(name) IN ('nation_7', 'nation_12')) SELECT source, target, weight FROM edge WHERE source IN (FROM k) OR target IN (FROM k)""")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with an end in one of two nations."""
    nodes, edges = (df.withColumn("chat_id", F.lit("shop")) for df in graph_tables(spark, sf_dir))
    names = nodes.filter("lower(name) in ('nation_7', 'nation_12')").select("chat_id", F.upper("name").alias("name"))
    return graph.around(nodes, edges, names)[1].select("source", "target", "weight")


@query("""WITH n AS (SELECT 'p' || p_partkey AS key, p_name AS name, p_partkey AS ord, [p_brand] AS aliases FROM part), t AS (SELECT DISTINCT p_name || ' [OBJECT]' AS input, lower(p_name) AS k FROM part UNION SELECT DISTINCT upper(p_brand), lower(p_brand) FROM part),
k AS (SELECT key, ord, lower(name) AS k FROM n UNION SELECT key, ord, lower(unnest(aliases)) FROM n) SELECT input, arg_min(key, ord) AS key FROM t JOIN k ON k.k = t.k GROUP BY input""")
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that a name with its type, or a brand, stands for."""
    p = read(spark, sf_dir, "part")
    nodes = p.select(F.lit("shop").alias("chat_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.col("p_partkey").alias("ord"))
    typed = p.select(F.concat("p_name", F.lit(" [OBJECT]")).alias("input")).unionByName(p.select(F.upper("p_brand").alias("input"))).distinct()
    return graph.merge_target(typed.withColumn("chat_id", F.lit("shop")), nodes).select("input", "key")


@query("""SELECT 'p' || p_partkey AS key, p_size::BIGINT AS mentions FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), '3')""")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name has an a or whose brand has a 3."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.col("p_size").cast("long").alias("mentions"), F.col("p_partkey").alias("ord"))
    return reports.search_nodes(p, "A", scope="name").select("key", "mentions").unionByName(reports.search_nodes(p, "3", scope="aliases").select("key", "mentions")).distinct()


@query(f"""WITH {GRAPH}, b AS (SELECT source AS key, target AS other, weight FROM edge UNION ALL SELECT target, source, weight FROM edge)
SELECT b.key, other, weight, row_number() OVER (PARTITION BY b.key ORDER BY weight DESC, node.name, other) AS place FROM b JOIN node ON node.key = other WHERE b.key LIKE 'n%'""")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each nation, heaviest first, then by name."""
    nodes, edges = (df.withColumn("chat_id", F.lit("shop")) for df in graph_tables(spark, sf_dir))
    return reports.relations_of(edges, nodes, nodes.filter("type = 'PLACE'")).select("key", "other", "weight", F.col("place").cast("long").alias("place"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS a, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS t, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS u FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY event_id) AS rn FROM e),
r AS (SELECT a, rn, least(10, greatest(0, 5 + t)) AS trust, least(10, greatest(0, u)) AS tension FROM o WHERE rn = 1
  UNION ALL SELECT o.a, o.rn, least(10, greatest(0, trust + t)), least(10, greatest(0, tension + u)) FROM r JOIN o ON o.a = r.a AND o.rn = r.rn + 1)
SELECT 'u' || a AS first, arg_max(trust, rn)::BIGINT AS trust, arg_max(tension, rn)::BIGINT AS tension FROM r GROUP BY a""")
def relationship_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust and tension between users and the shop by their events, each within 0 to 10."""
    kind = F.col("event_type")
    said = F.when(kind == "purchase", "Trust increases").when(kind == "error", "trust decreased").when(kind == "click", "tension increasing").when(kind == "view", "Tension decreases").otherwise("nothing")
    key = F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"), F.lit(" -> shop"))
    rows = read(spark, sf_dir, "events").select(F.lit("shop").alias("chat_id"), F.col("event_id").alias("ord"), F.create_map(key, said).alias("impact"))
    return graph.relationship_levels(rows).select("first", "trust", "tension")


# ---- dedup, reflections, contradictions

_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), nv AS (SELECT count(*) AS n FROM embeddings)"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(summary, '')), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2))"


#: Every fourth memory of a chat tells of hatred, and the next one of friendship, so that memories of the same characters contradict each other; each chat has all degrees of importance.
_MOODY = MEMORIES.replace("d.text AS summary", "d.text || CASE d.doc_id // 20 % 4 WHEN 0 THEN ' They hate each other.' WHEN 1 THEN ' They are friends.' ELSE '' END AS summary")
_MOODY = _MOODY.replace("1 + d.doc_id % 5 AS importance", "1 + d.doc_id // 20 % 5 AS importance")


def _moody(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.floor(F.col("id") / 20)
    told = F.when(turn % 4 == 0, " They hate each other.").when(turn % 4 == 1, " They are friends.").otherwise("")
    return memories(spark, sf_dir).withColumns({"summary": F.concat("summary", told), "importance": (1 + turn % 5).cast("int")})


@query(f"WITH {_MOODY}, {_mood_sql()} SELECT id, mood FROM mood")
def sentiment_moody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of memories of which some tell of hatred and some of friendship."""
    return _moody(spark, sf_dir).select("id", contradiction.sentiment(F.col("summary")).alias("mood"))


#: Memories 140 ids apart are of one chat and character. Of each four of these the first has a vector of its own, and the others the same with more and more noise; the second also has
#: the first one's text with an addition.
_TURN = "(doc_id // 140 % 4)"
_LIKE = MEMORIES.replace("FROM documents d", f"FROM (SELECT x.* REPLACE (CASE WHEN x.{_TURN[1:-1]} = 1 THEN coalesce(b.text, '') || ' once more' ELSE x.text END AS text) FROM documents x LEFT JOIN documents b ON b.doc_id = x.doc_id - 140) d")
_LIKE_VEC = f"""{_LIKE}, {_VEC}, lv AS (SELECT chat_id, mem.id, ord, summary, importance, character, type, archived, characters, mem.id // 140 % 4 AS turn,
  list_transform(e, lambda x, i: x + [0.0, 0.03, 0.05, 0.2][1 + mem.id // 140 % 4] * (i * 7 % 5 - 2)) AS e FROM mem, nv JOIN v ON v.id = (mem.id - 140 * (mem.id // 140 % 4)) % n)"""


def _like(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, n = _vectors(spark, sf_dir)
    mem, i = memories(spark, sf_dir), F.col("id")
    turn = F.floor(i / 140) % 4
    first = mem.select((i + 140).alias("id"), F.concat(F.coalesce("summary", F.lit("")), F.lit(" once more")).alias("__first"))
    rows = mem.join(first, "id", "left").withColumn("turn", turn)
    rows = rows.withColumns({"summary": F.when(F.col("turn") == 1, F.coalesce("__first", F.lit(" once more"))).otherwise(F.col("summary")), "vec_id": (i - 140 * F.col("turn")) % n})
    noise = F.when(F.col("turn") == 1, 0.03).when(F.col("turn") == 2, 0.05).when(F.col("turn") == 3, 0.2).otherwise(0.0)
    moved = F.transform("embedding", lambda x, k: x.cast("double") + noise * ((k + 1) * 7 % 5 - 2))
    return rows.join(table, "vec_id").withColumn("embedding", moved).drop("vec_id", "__first")


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with the given vectors, dealt out by id."""
    table = vectors(spark, sf_dir)
    n = table.count()
    return memories(spark, sf_dir).withColumn("v", F.col("id") % n).join(table.select(F.col("id").alias("v"), "embedding"), "v", "left").drop("v")


@query(f"""WITH {_LIKE_VEC}, w AS (SELECT chat_id, id, ord, turn, {_WORDS} AS w, e FROM lv),
p AS (SELECT a.chat_id, a.id, b.id AS other, b.ord, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m, list_cosine_similarity(a.e, b.e) AS s
      FROM w a JOIN w b ON a.chat_id = b.chat_id WHERE a.turn IN (1, 2) AND b.turn NOT IN (1, 2))
SELECT chat_id, id, arg_min(other, (ord, other)) AS match FROM p WHERE i > 0 AND i / (n + m - i)::DOUBLE >= 0.3 AND s >= 0.94 GROUP BY chat_id, id""")
def against_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third versions as new: the first stored memory that each repeats, by words and by vector, at the usual thresholds."""
    mem = _like(spark, sf_dir)
    return dedup.against_store(mem.filter("turn in (1, 2)"), mem.filter("turn not in (1, 2)"))


@query(f"""WITH {_LIKE_VEC},
p AS (SELECT a.chat_id, a.id, b.id AS match, b.ord, list_cosine_similarity(a.e, b.e) AS s FROM lv a JOIN lv b ON a.chat_id = b.chat_id AND lower(a.character) = lower(b.character) WHERE a.turn <> 0 AND b.turn = 0),
b AS (SELECT chat_id, id, arg_max(match, (s, -ord, match)) AS match, max(s) AS s FROM p GROUP BY ALL)
SELECT w.chat_id, w.id, CASE WHEN s >= 0.9 THEN 'reject' WHEN s >= 0.8 THEN 'replace' ELSE 'add' END AS verdict, CASE WHEN s >= 0.8 THEN match END AS match, round(coalesce(s, 0), 6) AS similarity
FROM lv w LEFT JOIN b ON b.chat_id = w.chat_id AND b.id = w.id WHERE w.turn <> 0""")
def reflection_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions as new reflections against the first ones of their character, at the usual thresholds."""
    mem = _like(spark, sf_dir)
    return rounded(dedup.judge_reflections(mem.filter("turn <> 0"), mem.filter("turn = 0")), "similarity")


@query(f"""WITH {_LIKE_VEC},
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, character ORDER BY importance DESC, ord) AS r FROM lv WHERE turn <> 0) WHERE r <= 3),
p AS (SELECT t.chat_id, t.character, t.id, max(coalesce(list_cosine_similarity(t.e, o.e), 0)) AS s FROM t LEFT JOIN lv o ON o.chat_id = t.chat_id AND o.character = t.character AND o.turn = 0 GROUP BY ALL)
SELECT chat_id, character, sum((s >= 0.85)::INT) >= ceil(count(*) / 2.0) AS skip FROM p GROUP BY ALL""")
def skip_reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of whose weightiest versions most resemble one of the first ones of theirs."""
    mem = _like(spark, sf_dir)
    return dedup.skip_reflection(mem.filter("turn <> 0"), mem.filter("turn = 0"))





@query(f"""WITH {_MOODY}, {_mood_sql()}, m AS (SELECT chat_id, id, ord, type, archived, list_distinct(characters) AS cs, mood FROM mood WHERE mood <> 'neutral' AND len(characters) >= 2),
p AS (SELECT a.chat_id, a.id, b.id AS other, b.ord FROM m a JOIN m b ON a.chat_id = b.chat_id AND a.id <> b.id AND list_has_any(a.cs, b.cs) AND a.mood <> b.mood WHERE a.id % 5 = 0 AND NOT b.archived AND b.type <> 'reflection')
SELECT chat_id, id, other, row_number() OVER (PARTITION BY chat_id, id ORDER BY ord, other) AS place FROM p""")
def opposed_to_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth memory as new: the stored ones of the opposite sentiment that share a character."""
    mem = _moody(spark, sf_dir)
    return contradiction.against_new(mem.filter("id % 5 = 0"), mem).select("chat_id", "id", "other", F.col("place").cast("long").alias("place"))


@query(f"""WITH {MEMORIES}, {_VEC}, w AS (SELECT chat_id, mem.id, type, archived, characters AS c, e FROM mem, nv JOIN v ON v.id = mem.id % n),
p AS (SELECT a.chat_id, a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS s FROM w a JOIN w b ON a.chat_id = b.chat_id AND a.id <> b.id AND list_has_any(a.c, b.c) WHERE a.id % 5 = 0 AND NOT b.archived AND b.type <> 'reflection'),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, id ORDER BY round(s, 9) DESC, other) AS place FROM p WHERE round(s, 9) >= 0.2)
SELECT chat_id, id, other, round(s, 6) AS similarity, place FROM r WHERE place <= 10""")
def similar_to_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth memory as new: the ten stored events most like it that share a character."""
    mem = _with_vectors(spark, sf_dir)
    return rounded(contradiction.similar_to_new(mem.filter("id % 5 = 0"), mem, 0.2), "similarity").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {MEMORIES}, c AS (SELECT chat_id, id, ord, unnest([1, 2, 3, 4]) AS place FROM mem WHERE id % 6 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY place, ord, id) AS turn FROM c WHERE place <= 3) SELECT chat_id, id, place::BIGINT AS place, turn FROM r WHERE turn <= 20""")
def checks_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four checks for every sixth memory, of which a budget of 20 for each chat pays the first of each before the second of any."""
    checks = memories(spark, sf_dir).filter("id % 6 = 0").select("chat_id", "id", "ord", F.col("id").alias("other"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place"))
    return contradiction.in_turns(checks, 20).select("chat_id", "id", F.col("place").cast("long").alias("place"), F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {MEMORIES}, p AS (SELECT chat_id, 'k' || (id % 50) AS pair_key, max(ord) AS ord FROM mem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ord DESC, pair_key) AS k FROM p)
SELECT chat_id, pair_key, ord FROM r WHERE k <= 10""")
def remembered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pairs of each chat that were analysed last."""
    pairs = memories(spark, sf_dir).select("chat_id", F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("pair_key"), "ord", "id")
    return contradiction.remember_pairs(pairs.filter("id % 2 = 0").drop("id"), pairs.filter("id % 2 <> 0").drop("id"), 10)


# ---- retrieval


_CAPPED = f"""{_BALANCE}, ranked AS (SELECT *, CASE WHEN importance = 5 THEN row_number() OVER (PARTITION BY chat_id, importance = 5 ORDER BY score DESC, ord) ELSE 0 END AS k FROM sel),
kept AS (SELECT * FROM ranked WHERE k <= 2), ku AS (SELECT chat_id, sum(n_tokens) AS t FROM kept GROUP BY chat_id),
fill AS (SELECT * FROM (SELECT top.*, coalesce(t, 0) AS t, sum(n_tokens) OVER (PARTITION BY top.chat_id ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS u
         FROM top LEFT JOIN ku ON ku.chat_id = top.chat_id
         WHERE importance <> 5 AND top.id NOT IN (SELECT id FROM sel) AND top.chat_id IN (SELECT chat_id FROM ranked WHERE k > 2)) WHERE u <= 4000 - t),
capped AS (SELECT chat_id, id FROM kept UNION ALL SELECT chat_id, id FROM fill)"""


@query(f"""WITH {_CAPPED}, mem3 AS (SELECT mem.* FROM mem JOIN capped ON capped.chat_id = mem.chat_id AND capped.id = mem.id), {_mood_sql().replace("FROM mem)", "FROM mem3)")},
g AS (SELECT chat_id, id, mood, extraction_count AS tm, array_to_string(list_sort(list_transform(characters, lambda c: trim(lower(c)))), '|') AS grp FROM mood WHERE mood <> 'neutral'),
nw AS (SELECT chat_id, grp, max(tm) FILTER (mood = 'positive') AS p, max(tm) FILTER (mood = 'negative') AS q FROM g GROUP BY ALL),
lost AS (SELECT g.chat_id, id FROM g JOIN nw ON nw.chat_id = g.chat_id AND nw.grp = g.grp WHERE (p > q AND mood = 'negative') OR (q > p AND mood = 'positive'))
SELECT chat_id, id FROM capped WHERE (chat_id, id) NOT IN (FROM lost)""")
def full_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chat is given at last: balanced under 4,000 tokens, two memories of importance 5 at most, none contradicted."""
    texts = memories(spark, sf_dir).select("chat_id", "id", "characters", "summary")
    return retrieval.select(_bucketed(spark, sf_dir).drop("summary"), 4000, texts=texts).select("chat_id", "id")


_FLAT = r"trim(regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', '', 'g'))"
_HAS_PHRASE = f"contains({_FLAT.format('summary')}, {_FLAT.format('phrase')}) AND length({_FLAT.format('phrase')}) > 0"


@query(rf"""WITH {MEMORIES}, w AS (SELECT item_id, regexp_split_to_array(trim(text), '\s+') AS w FROM benchmark),
p AS (SELECT item_id AS query_id, w[1] || ' ' || w[2] || ' ' || w[3] AS phrase FROM w UNION SELECT item_id, right(w[2], 5) || ' ' || left(w[3], 4) FROM w UNION SELECT item_id, w[1] || ' - ' || w[2] FROM w)
SELECT query_id, phrase, chat_id, id FROM p JOIN mem ON {_HAS_PHRASE}""")
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have the first three words of a benchmark item as a phrase, the end of its second word before the start of its third, or its first two words around a dash, by places of words."""
    w = F.split(F.trim("text"), r"\s+")
    three = F.concat_ws(" ", F.slice(w, 1, 3))
    ends = F.concat(F.right(F.get(w, F.lit(1)), F.lit(5)), F.lit(" "), F.left(F.get(w, F.lit(2)), F.lit(4)))
    dash = F.concat(F.get(w, F.lit(0)), F.lit(" - "), F.get(w, F.lit(1)))
    phrases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(three, ends, dash)).alias("phrase")).distinct()
    found = lexical.phrase_matches(phrases, lexical.positions(memories(spark, sf_dir)))
    return found.join(phrases, "phrase").select("query_id", "phrase", "chat_id", "id")


@query(ORACLES["bm25_topk"])
def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bm25_topk by an index of blocks, of which those of frequent terms are read only where they can matter."""
    told = staging.written(lexical.tokenized(memories(spark, sf_dir)), "tokens")
    terms = lexical.query_terms(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    terms = staging.written(terms, "query-terms")
    best, _ = blockmax.top(terms, blockmax.index(told, terms=terms), 5)
    return rounded(best.select("query_id", "chat_id", "id", "bm25", F.col("rank").cast("long").alias("rank")), "bm25")


@query(rf"""WITH {MEMORIES.replace("FROM documents d", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 1 THEN coalesce(text, '') || ' changed wording' ELSE text END AS text) FROM documents) d")},
{_CORPUS.replace(MEMORIES, "one AS (SELECT 1)").replace("FROM mem)", "FROM mem WHERE id % 7 <> 2)")} SELECT chat_id, term, df, round(idf, 6) AS idf FROM idf2""")
def kept_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idf of all terms after three batches of changes: all memories come in, every fifth is reworded, every seventh is archived; the corpus is read by none of the later ones."""
    mem = staging.written(memories(spark, sf_dir).select("chat_id", "id", "summary"), "memories")
    kept = statistics.Statistics(spark, staging.new_path(spark, "statistics"))
    kept.apply(1, added=mem)
    reworded = mem.filter("id % 5 = 1")
    newer = reworded.withColumn("summary", F.concat(F.coalesce("summary", F.lit("")), F.lit(" changed wording")))
    kept.apply(2, added=newer, removed=reworded)
    kept.apply(3, removed=mem.filter("id % 7 = 2 and id % 5 != 1").unionByName(newer.filter("id % 7 = 2")))
    return rounded(kept.compact(staging.new_path(spark, "statistics")).idf(), "idf")


_RECALL = rf"""WITH {_CORPUS.replace(MEMORIES, _MOODY)}, {_VEC}, {_DECAY}, q AS (SELECT item_id AS query_id, text, regexp_split_to_array(trim(text), '\s+') AS w FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, term, sum(cnt)::BIGINT AS cnt FROM (
  SELECT query_id, term, CASE WHEN term IN (SELECT term FROM post) THEN 3 ELSE 2 END AS cnt FROM (SELECT query_id, unnest(list_distinct({_ITEMS})) AS term FROM q)
  UNION ALL SELECT query_id, term, 10 FROM (SELECT query_id, unnest({_ITEMS.replace('text', 'w[3]')}) AS term FROM q)) GROUP BY ALL), {_BM25},
ph AS (SELECT query_id, chat_id, id FROM (SELECT query_id, w[1] || ' ' || w[2] AS phrase FROM q) JOIN mem ON {_HAS_PHRASE}),
raw AS (SELECT query_id, chat_id, id, bm25 FROM bm UNION ALL SELECT query_id, ph.chat_id, id, 10.0 * top FROM ph JOIN (SELECT chat_id, max(idf) AS top FROM idf2 GROUP BY chat_id) m ON m.chat_id = ph.chat_id),
hit AS (SELECT query_id, chat_id, id, sum(bm25) AS bm25 FROM raw WHERE id IN (SELECT id FROM mem WHERE NOT archived) GROUP BY ALL),
mx AS (SELECT query_id, chat_id, greatest(max(bm25), 1e-9) AS top FROM hit GROUP BY ALL), len AS (SELECT chat_id, max(extraction_count) AS n FROM mem GROUP BY chat_id),
s AS (
  SELECT q.query_id, b.chat_id, b.id, b.ord, b.importance, b.summary, b.characters, b.extraction_count, base_after_floor, frequency, 0.3 * 15.0 * coalesce(bm25 / top, 0) AS bonus, reflection,
         list_cosine_similarity(a.e, c.e) AS sim, 100 + b.id % 400 AS n_tokens,
         CASE WHEN b.extraction_count >= greatest(0, len.n - 100) THEN 'recent' WHEN b.extraction_count >= greatest(0, len.n - 500) THEN 'mid' ELSE 'old' END AS bucket
  FROM base b CROSS JOIN q CROSS JOIN nv JOIN len ON len.chat_id = b.chat_id LEFT JOIN v a ON a.id = q.query_id % nv.n LEFT JOIN v c ON c.id = b.id % nv.n
  LEFT JOIN hit ON hit.query_id = q.query_id AND hit.chat_id = b.chat_id AND hit.id = b.id LEFT JOIN mx ON mx.query_id = q.query_id AND mx.chat_id = b.chat_id WHERE NOT archived
), f AS (SELECT *, (base_after_floor + bonus) * frequency * reflection AS fast FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chat_id ORDER BY fast DESC, ord) AS r FROM f),
t AS (SELECT *, round(CASE WHEN r <= 200 AND sim > 0.1 THEN (base_after_floor + bonus + 0.7 * 15.0 * (sim - 0.1) / 0.9) * frequency ELSE fast END, 9) AS score FROM r),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chat_id ORDER BY score DESC, ord) AS rank FROM t) WHERE rank <= 1000),
rk AS (SELECT *, CASE WHEN rank <= 50 AND (rank - 1) % 2 = 0 THEN ((rank - 1) * 37 % 11) / 10.0 END AS rs FROM top),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, chat_id ORDER BY rs IS NULL, rs DESC, rank) AS place FROM rk),
p1 AS (SELECT * FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id, chat_id, bucket ORDER BY place ROWS UNBOUNDED PRECEDING) AS u FROM pl) WHERE u <= 4000 * 0.2),
us AS (SELECT query_id, chat_id, sum(n_tokens) AS t FROM p1 GROUP BY ALL),
p2 AS (SELECT * FROM (SELECT pl.*, coalesce(t, 0) AS t, sum(n_tokens) OVER (PARTITION BY pl.query_id, pl.chat_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS u
       FROM pl LEFT JOIN us ON us.query_id = pl.query_id AND us.chat_id = pl.chat_id WHERE (pl.query_id, pl.id) NOT IN (SELECT query_id, id FROM p1)) WHERE u <= 4000 - t),
sel AS (SELECT *, 1 AS phase FROM (SELECT * EXCLUDE (u) FROM p1) UNION ALL SELECT *, 2 FROM (SELECT * EXCLUDE (u, t) FROM p2)),
cap AS (SELECT *, CASE WHEN importance = 5 THEN row_number() OVER (PARTITION BY query_id, chat_id, importance = 5 ORDER BY score DESC, ord) ELSE 0 END AS k FROM sel),
kept AS (SELECT * FROM cap WHERE k <= 2), ku AS (SELECT query_id, chat_id, sum(n_tokens) AS t FROM kept GROUP BY ALL),
fill AS (SELECT * FROM (SELECT pl.*, coalesce(t, 0) AS t, sum(n_tokens) OVER (PARTITION BY pl.query_id, pl.chat_id ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS u
         FROM pl LEFT JOIN ku ON ku.query_id = pl.query_id AND ku.chat_id = pl.chat_id
         WHERE importance <> 5 AND (pl.query_id, pl.id) NOT IN (SELECT query_id, id FROM sel) AND (pl.query_id, pl.chat_id) IN (SELECT query_id, chat_id FROM cap WHERE k > 2)) WHERE u <= 4000 - t),
given AS (SELECT query_id, chat_id, id, summary, characters, extraction_count, score, phase FROM kept UNION ALL SELECT query_id, chat_id, id, summary, characters, extraction_count, score, 3 FROM fill),
{_mood_sql().replace("FROM mem)", "FROM given)")},
g AS (SELECT query_id, chat_id, id, mood, extraction_count AS tm, array_to_string(list_sort(list_transform(characters, lambda c: trim(lower(c)))), '|') AS grp FROM mood WHERE mood <> 'neutral'),
nw AS (SELECT query_id, chat_id, grp, max(tm) FILTER (mood = 'positive') AS p, max(tm) FILTER (mood = 'negative') AS q FROM g GROUP BY ALL),
lost AS (SELECT g.query_id, id FROM g JOIN nw ON nw.query_id = g.query_id AND nw.chat_id = g.chat_id AND nw.grp = g.grp WHERE (p > q AND mood = 'negative') OR (q > p AND mood = 'positive')),
final AS (SELECT * FROM given WHERE (query_id, id) NOT IN (FROM lost))"""


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = _distance(_moody(spark, sf_dir))
    length = mem.groupBy("chat_id").agg(F.max("extraction_count").alias("n"))
    table, n = _vectors(spark, sf_dir)
    mem = mem.join(F.broadcast(length), "chat_id").withColumn("bucket", selection.bucket(F.col("extraction_count"), F.col("n"))).drop("n")
    mem = mem.withColumns({"n_tokens": 100 + F.col("id") % 400, "vec_id": F.col("id") % n})
    items = read(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % n).alias("vec_id"))
    items = items.join(table.withColumnRenamed("embedding", "query_vector"), "vec_id", "left").drop("vec_id")
    queries = items.join(F.broadcast(mem.select("chat_id").distinct()), F.lit(True))
    w = F.split(F.trim("text"), r"\s+")
    entities = items.select("query_id", F.explode(F.array(F.concat_ws(" ", F.slice(w, 1, 2)), F.get(w, F.lit(2)))).alias("name"), F.lit(1.0).alias("weight"))

    def reranker(top: DataFrame) -> DataFrame:
        """Stands for an outside model: scores for every second of the first rows."""
        return top.filter("(rank - 1) % 2 = 0").select("query_id", "chat_id", (F.col("rank") - 1).alias("index"), ((F.col("rank") - 1) * 37 % 11 / F.lit(10.0)).alias("score"))

    return retrieval.recall(mem, queries, entities, table, 4000, reranker, Settings(vector_threshold=0.1))


@query(f"{_RECALL} SELECT query_id, chat_id, id, phase, round(score, 6) AS score FROM final")
def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval as a whole: for every twentieth benchmark item what each chat gives it, by words in tiers, phrases, vectors and a reranker, under a budget, without what is contradicted."""
    return rounded(_recalled(spark, sf_dir).select("query_id", "chat_id", "id", "phase", "score"), "score")


@query(f"""WITH {_FAST}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY score DESC, ord) AS rank FROM sc) WHERE rank <= 60),
rk AS (SELECT *, CASE WHEN rank <= 50 AND (rank - 1) % 2 = 0 THEN ((rank - 1) * 37 % 11) / 10.0 END AS rs FROM top)
SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY rs IS NULL, rs DESC, rank) AS place FROM rk""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 best memories of each chat after every second of the first 50 got a score from outside."""
    top = scoring.best(_bucketed(spark, sf_dir), 60)
    ranked = top.filter("(rank - 1) % 2 = 0").select("query_id", "chat_id", (F.col("rank") - 1).alias("index"), ((F.col("rank") - 1) * 37 % 11 / F.lit(10.0)).alias("score"))
    return retrieval.rerank(top, ranked).select("chat_id", "id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {MEMORIES}, h AS (SELECT chat_id, id, CASE WHEN chat_id LIKE '%1' THEN id + 1000000 ELSE id END AS hit, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS place FROM mem WHERE id % 4 <> 2),
n AS (SELECT *, count(*) OVER (PARTITION BY chat_id) AS n FROM h)
SELECT n.chat_id, n.id, round(CASE WHEN n <= 1 THEN 1.0 ELSE 1 - (place - 1) / (n - 1)::DOUBLE * 0.5 END, 6) AS similarity FROM n WHERE hit = id
UNION ALL SELECT chat_id, id, NULL FROM mem WHERE chat_id LIKE '%1' AND chat_id IN (SELECT chat_id FROM n)""")
def external_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by an outside index: proxy scores by rank; chats for which it found communities only fall back to all memories."""
    mem = memories(spark, sf_dir)
    away = F.col("chat_id").endswith("1")
    hits = ranking.top_n(mem.filter("id % 4 <> 2").select("chat_id", "id"), ["chat_id"], [F.desc("id")], 1_000_000, "place")
    hits = hits.select(F.lit(0).alias("query_id"), "chat_id", F.when(away, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("id"), "place")
    groups = mem.select("chat_id", (F.col("id") + 1_000_000).alias("id"))
    found, _ = retrieval.from_hits(hits, mem.select("chat_id", "id"), groups)
    return rounded(found.select("chat_id", "id", "similarity"), "similarity")


@query("""WITH v AS (SELECT vec_id AS id, 'c' || vec_id % 2 AS chat_id, CASE WHEN vec_id % 9 = 1 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id % 7 <> 3),
s AS (SELECT q.vec_id AS query_id, v.id, list_cosine_similarity(q.embedding::DOUBLE[], v.e) AS similarity FROM embeddings q JOIN v ON v.chat_id = 'c' || q.vec_id % 2 WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM s) SELECT query_id, id, round(similarity, 4) AS similarity, place FROM r WHERE place <= 5""")
def kept_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to every twentieth, from an index that was made of two thirds of the vectors, then got the others and new versions of every ninth, and lost every seventh."""
    table = vectors(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id") % 2).alias("chat_id"), "id", "embedding")
    index = vector_store.ListIndex.create(table.filter("id % 3 <> 0"), staging.new_path(spark, "list-index"), 16)
    index.insert(table.filter("id % 3 = 0"), 2)
    index.insert(table.filter("id % 9 = 1").withColumn("embedding", F.reverse("embedding")), 3)
    index.delete(table.filter("id % 7 = 3"), 4)
    queries = table.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "chat_id", F.col("embedding").alias("query_vector"))
    best, _ = index.search(queries, 5, 4, exact=True)
    return best.select("query_id", "id", F.round("similarity", 4).alias("similarity"), F.col("place").cast("long").alias("place"))


@query()
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each query (ids divisible by 20) by an index of inverted lists; tests hold its recall against ``cosine_topk``."""
    table = vectors(spark, sf_dir)
    queries = table.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    centroids, members = scoring.index_lists(table, 16)
    found = scoring.nearest_in_lists(centroids, members, queries, 10, 11, 0.2)
    return rounded(found.select("query_id", "id", "similarity", F.col("place").cast("long").alias("place")), "similarity")


@query(f"""WITH {MEMORIES}, a AS (SELECT chat_id, id FROM mem WHERE id % 7 = 0 AND chat_id NOT LIKE '%1') SELECT chat_id, id FROM a UNION ALL SELECT chat_id, id FROM mem WHERE chat_id NOT IN (SELECT chat_id FROM a)""")
def pov_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be seen; in chats where that is nothing, everything hidden."""
    mem = memories(spark, sf_dir).select("chat_id", "id")
    return retrieval.or_all(mem.filter((F.col("id") % 7 == 0) & ~F.col("chat_id").endswith("1")), mem)


@query(f"""WITH {_LOG}, l AS (SELECT chat_id, count(*) AS chat_length FROM msg GROUP BY chat_id), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY idx DESC) AS k FROM log),
u AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY idx DESC) AS k FROM log WHERE is_user), s AS (SELECT chat_id, right(string_agg(mes, chr(10) ORDER BY idx), 1000) AS said FROM u WHERE k <= 3 GROUP BY chat_id),
n AS (SELECT chat_id, string_agg(mes, chr(10) ORDER BY k) AS recent FROM r WHERE k <= 10 GROUP BY chat_id)
SELECT l.chat_id, chat_length, coalesce(recent, '') AS recent, coalesce(said, '') AS said, 6000 AS scene, 2000 AS entity, 2000 AS world FROM l LEFT JOIN s ON s.chat_id = l.chat_id LEFT JOIN n ON n.chat_id = l.chat_id""")
def chat_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retrieval starts from in each chat: the newest messages, what the user said, and the budgets."""
    rows = retrieval.scene(messages(spark, sf_dir))
    return rows.withColumn("recent", F.coalesce(F.array_join("recent", "\n"), F.lit(""))).withColumns({c: F.col(c).cast("long") for c in ("scene", "entity", "world")})


@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY idx DESC) AS k FROM log), n AS (SELECT chat_id, string_agg(mes, ' ' ORDER BY k) FILTER (length(mes) > 0) AS t FROM r WHERE k <= 5 GROUP BY chat_id)
SELECT l.chat_id, trim('Castle ' || left(coalesce(t, ''), 293)) AS q FROM (SELECT DISTINCT chat_id FROM log) l LEFT JOIN n ON n.chat_id = l.chat_id""")
def embedding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of 300 characters whose vector stands for each chat: an entity that isn't present, then the newest messages."""
    rows = retrieval.scene(messages(spark, sf_dir)).filter(F.col("recent").isNotNull())
    names, active = F.array(F.lit("ALICE"), F.lit("Castle")), F.array(F.lit("Alice"))
    return rows.select("chat_id", retrieval.embedding_query(F.col("recent"), names, active, 300).alias("q"))


_ITEM_WORDS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], w))"
_TERMS = _ITEM_WORDS.replace("text", "summary")


@query(f"""WITH {MEMORIES}, voc AS (SELECT DISTINCT unnest({_TERMS}) AS term FROM mem), i AS (SELECT item_id AS query_id, {_ITEM_WORDS} AS t FROM benchmark),
s AS (SELECT query_id, unnest(list_distinct(t)) AS term FROM i)
SELECT query_id, t[1] || ' ' || t[2] AS term, 1 AS count, 'phrase' AS tier FROM i WHERE len(t) >= 2
UNION ALL SELECT query_id, t[1], 12, 'entity' FROM i WHERE len(t) >= 1
UNION ALL SELECT query_id, s.term, CASE WHEN voc.term IS NULL THEN 2 ELSE 3 END, CASE WHEN voc.term IS NULL THEN 'free' ELSE 'grounded' END FROM s LEFT JOIN voc ON voc.term = s.term""")
def query_tiers_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four tiers of terms: the first word of each benchmark item as an entity, its first two as a phrase, all words by whether memories have them."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").withColumn("t", text.tokens(F.col("text")))
    one = items.filter(F.size("t") >= 1).select("query_id", F.element_at("t", 1).alias("name"), F.lit(1.2).alias("weight"))
    two = items.filter(F.size("t") >= 2).select("query_id", F.array_join(F.slice("t", 1, 2), " ").alias("name"), F.lit(1.0).alias("weight"))
    return retrieval.query_terms(items.select("query_id", "text"), one.unionByName(two), lexical.vocabulary(memories(spark, sf_dir)))


@query(f"""WITH {_BALANCE}, r AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.chat_id ORDER BY sc.score DESC, sc.ord) AS place FROM sc WHERE (sc.chat_id, sc.id) NOT IN (SELECT chat_id, id FROM sel))
SELECT chat_id, id, round(score, 6) AS score, place FROM r WHERE place <= 15""")
def rejected_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 best memories of each chat that the balanced selection left out."""
    rows = _bucketed(spark, sf_dir)
    detail = retrieval.details(rows, selection.soft_balance(scoring.best(rows, 1000), 4000))
    return rounded(retrieval.rejected(detail).select("chat_id", "id", "score", F.col("rank").cast("long").alias("place")), "score")


@query(f"""WITH {_LOG}, r AS (SELECT *, count(*) OVER (PARTITION BY chat_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM log), s AS (SELECT chat_id, count(*) AS scanned FROM r WHERE back < 10 GROUP BY chat_id),
w AS (SELECT chat_id, back, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(mes, '')), '[\\p{{L}}0-9_]+'), lambda w: length(w) > 2))) AS word FROM r WHERE back < 10),
h AS (SELECT DISTINCT chat_id, back, upper(word[1:1]) || word[2:] AS name FROM w WHERE length(word) >= 6), f AS (SELECT chat_id, name, sum(1 - back * 0.09) AS weight, count(*) AS n FROM h GROUP BY ALL),
x AS (SELECT f.chat_id, name, round(weight, 6) AS weight, row_number() OVER (PARTITION BY f.chat_id ORDER BY round(weight, 9) DESC, name) AS place FROM f JOIN s ON s.chat_id = f.chat_id WHERE n <= scanned * 0.5)
SELECT chat_id, name, weight, place FROM x WHERE place <= 5""")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that each chat's last messages speak of, where every longer word is one."""
    log = messages(spark, sf_dir).filter(~F.col("is_system"))
    log = log.join(log.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")), "chat_id")
    placed = ranking.place(log, "chat_id", "idx", [], 1000).withColumn("back", F.col("n") - F.col("place"))
    words = placed.select("chat_id", F.explode(text.words(F.col("mes"))).alias("word")).filter(F.length("word") >= 6).distinct()
    names = words.withColumn("name", text.capitalized(F.col("word")))
    nobody = names.select("chat_id", "name").limit(0)
    found = lexical.mentioned_entities(placed.select("chat_id", "back", "mes"), names, nobody)
    return rounded(found.select("chat_id", "name", "weight", F.col("place").cast("long").alias("place")), "weight")


# ---- texts and reports


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe,
CASE WHEN length(html) > 80 THEN left(html, 77) || '...' ELSE html END AS short FROM pages""")
def safe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what HTML takes for markup escaped, and cut to 80 characters."""
    return read(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("safe"), text.truncate(F.col("html"), 80).alias("short"))


@query(f"""WITH {MEMORIES} SELECT chat_id, id, repeat('★', importance::INT) || repeat('☆', (5 - importance)::INT) AS stars, '[' || repeat('★', importance::INT) || '] ' || CASE WHEN id % 2 = 0 THEN '[day ' || id || '] ' ELSE '' END
|| CASE WHEN id % 3 = 0 THEN '[Known] ' ELSE '' END || coalesce(summary, '') AS line FROM mem WHERE summary IS NOT NULL""")
def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory as a line of a prompt."""
    mem = memories(spark, sf_dir).filter(F.col("summary").isNotNull())
    anchor = F.when(F.col("id") % 2 == 0, F.concat(F.lit("day "), F.col("id").cast("string")))
    return mem.select("chat_id", "id", text.stars(F.col("importance")).alias("stars"), context.memory_line(F.col("importance"), anchor, F.col("id") % 3 == 0, F.col("summary")).alias("line"))


_TO_CYRILLIC = ("0123456789", "абвжщюяхцч")


@query(f"""WITH n AS (SELECT c_custkey, translate(lower(c_name), '{_TO_CYRILLIC[0]}', '{_TO_CYRILLIC[1]}') AS n FROM customer)
SELECT c_custkey, n AS name, """ + "replace(" * len(language.SEVERAL) + f"translate(n, '{language.CYRILLIC}', '{language.LATIN}')" + "".join(f", '{a}', '{b}')" for a, b in language.SEVERAL.items()) + " AS latin FROM n")
def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with Cyrillic letters for digits, written in Latin ones."""
    name = F.translate(F.lower("c_name"), *_TO_CYRILLIC)
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), language.transliterate(name).alias("latin"))


@query(f"""WITH {MEMORIES} SELECT chat_id, id, CASE WHEN id % 3 = 0 THEN floor((id + id + 2) / 2.0 + 0.5) WHEN id % 3 = 1 THEN sequence // 1000 ELSE 0 END::BIGINT AS position FROM mem""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where memories stand in their chat: by their messages, else by their sequence."""
    i = F.col("id")
    ids, sequence = F.when(i % 3 == 0, F.array(i, i + 2)).otherwise(F.array().cast("array<bigint>")), F.when(i % 3 == 1, F.col("sequence"))
    return memories(spark, sf_dir).select("chat_id", "id", scoring.position(ids, sequence).alias("position"))


@query(f"""WITH {MEMORIES} SELECT chat_id, id, p AS place, id - p * 50 AS source_id, NOT EXISTS (SELECT 1 FROM mem g WHERE g.chat_id = m.chat_id AND g.id = m.id - p * 50) AS missing
FROM mem m, (VALUES (0), (1), (2)) t(p) WHERE m.type = 'reflection'""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reflection rests on, and whether it is still there."""
    mem = memories(spark, sf_dir)
    i = F.col("id")
    return reports.evidence(mem.filter("type = 'reflection'").withColumn("source_ids", F.array(i, i - 50, i - 100)), mem).select("chat_id", "id", F.col("place").cast("long").alias("place"), "source_id", "missing")


@query("SELECT user_id AS chat_id, event_type AS metric, arg_max(value, (ts, value)) AS value, count(*) AS n FROM events GROUP BY ALL")
def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each kind of event of each user."""
    return reports.last_values(read(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), F.col("event_type").alias("metric"), "ts", "value"))


@query(f"""WITH {MEMORIES}, p AS (SELECT chat_id, unnest(list_distinct(characters)) AS c FROM mem)
SELECT m.chat_id, count(*) AS memories, count(*) FILTER (type = 'reflection') AS reflections, count(*) FILTER (id % 2 = 0) AS vectors, count(*) FILTER (archived) AS archived,
       (SELECT count(DISTINCT c) FROM p WHERE p.chat_id = m.chat_id) AS characters, 0 AS communities, (SELECT count(*) FROM nation WHERE 'src' || n_nationkey = m.chat_id) AS entities FROM mem m GROUP BY m.chat_id""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a store's overview, chat by chat."""
    mem = memories(spark, sf_dir).withColumn("embedding", F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0))))
    states = reports.characters(mem).select("chat_id", "character")
    nodes = read(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("chat_id"))
    return reports.dashboard(mem, states, mem.select("chat_id").limit(0), nodes)


@query(f"""WITH {MEMORIES} SELECT chat_id, 'memories' AS kind, count(*) AS vectors FROM mem WHERE id % 2 = 0 GROUP BY chat_id UNION ALL SELECT chat_id, 'nodes', count(*) FROM mem WHERE id % 9 = 0 GROUP BY chat_id""")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories and nodes of each chat have a vector."""
    mem = memories(spark, sf_dir)
    has = F.array(F.lit(1.0))
    return reports.vector_counts(memories=mem.withColumn("embedding", F.when(F.col("id") % 2 == 0, has)), nodes=mem.withColumn("embedding", F.when(F.col("id") % 9 == 0, has)))


@query(f"""WITH {MEMORIES}, m AS (SELECT *, CASE WHEN id % 4 <> 0 THEN 1000 - id END AS message_id, 7 * id % 31 AS created_at FROM mem)
SELECT chat_id, id, row_number() OVER (ORDER BY message_id IS NULL, CASE WHEN message_id IS NULL THEN created_at ELSE message_id END, ord) AS place FROM m ORDER BY place LIMIT 20 OFFSET 40""")
def story_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the timeline: by message, those without one last."""
    i = F.col("id")
    mem = memories(spark, sf_dir).withColumns({"message_id": F.when(i % 4 != 0, 1000 - i), "created_at": 7 * i % 31})
    page = reports.page(mem, reports.story_order(), 2)
    placed = ranking.top_n(page.withColumn("lost", F.col("message_id").isNull()), [], reports.story_order(), 20)
    return placed.select("chat_id", "id", (F.col("rank") + 40).cast("long").alias("place"))


@query(f"""WITH {MEMORIES}, p AS (SELECT chat_id, id, ord, unnest(list_distinct(characters)) AS character, CASE WHEN id % 3 = 0 THEN NULL ELSE 'mood ' || (id % 5) END AS emotion FROM mem)
SELECT chat_id, character, arg_max(emotion, ord) FILTER (emotion IS NOT NULL) AS emotion, count(*) AS known_events, min(id) AS first_message, max(id) AS last_message FROM p GROUP BY chat_id, character""")
def character_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character's state after all memories: the last emotion told, how many events it knows, and the first and last message."""
    emotion = F.when(F.col("id") % 3 != 0, F.concat(F.lit("mood "), (F.col("id") % 5).cast("string")))
    told = F.map_from_entries(F.transform(F.array_distinct("characters"), lambda c: F.struct(c.alias("key"), emotion.alias("value"))))
    mem = memories(spark, sf_dir).select("chat_id", "id", "ord", F.array("id").alias("message_ids"), told.alias("emotions"))
    states = maintenance.character_states(mem)
    return reports.character_counts(states).join(states.select("chat_id", "character", "first_message", "last_message"), ["chat_id", "character"]).withColumn("known_events", F.col("known_events").cast("long"))


@query(f"""WITH {MEMORIES}, g AS (SELECT chat_id, id % 5 AS id, list_sort(list(id::VARCHAR)) AS new FROM mem WHERE id % 5 < 4 GROUP BY ALL), k AS (SELECT chat_id, id % 5 AS id, list_sort(list(id::VARCHAR)) AS old FROM mem WHERE id % 5 > 0 GROUP BY ALL)
SELECT coalesce(g.chat_id, k.chat_id) AS chat_id, coalesce(g.id, k.id) AS id, CASE WHEN new IS NULL THEN 'drop' WHEN old IS NULL OR new <> old OR 120 - CASE WHEN k.id = 2 THEN 10 ELSE 100 END >= 100 OR k.id = 3 THEN 'summarise' ELSE 'keep' END AS action
FROM g FULL JOIN k ON k.chat_id = g.chat_id AND k.id = g.id""")
def community_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which communities need a new summary: new ones, old summaries, and those without a vector; and which are gone."""
    mem = memories(spark, sf_dir).withColumn("g", F.col("id") % 5)

    def groups(df: DataFrame) -> DataFrame:
        return df.groupBy("chat_id", F.col("g").alias("id")).agg(F.collect_list(F.col("id").cast("string")).alias("node_keys"))

    known = groups(mem.filter("g > 0")).withColumn("last_count", F.when(F.col("id") == 2, 10).otherwise(100)).withColumn("embedding", F.when(F.col("id") != 3, F.array(F.lit(1.0))))
    return communities.stale(groups(mem.filter("g < 4")), known, 120)


@query(f"WITH {MEMORIES} SELECT chat_id, id, ((row_number() OVER (PARTITION BY chat_id ORDER BY ord)) - 1) // 10 AS chunk FROM mem")
def community_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each chat in tens, as a synthesis in two steps takes them."""
    return communities.chunks(memories(spark, sf_dir)).select("chat_id", "id", F.col("chunk").cast("long").alias("chunk"))


@query(f"""WITH {GRAPH}, m AS (SELECT key, CASE WHEN key LIKE 'n%' THEN -1 ELSE substr(key, 2)::BIGINT % 4 END AS c FROM node)
SELECT source, target, a.c AS community FROM edge JOIN m a ON a.key = source JOIN m b ON b.key = target AND b.c = a.c""")
def inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose two ends are in one group of customers and parts by number."""
    nodes, edges = (df.withColumn("chat_id", F.lit("shop")) for df in graph_tables(spark, sf_dir))
    member = nodes.select("chat_id", "key", F.when(F.col("type") == "PLACE", -1).otherwise(F.expr("cast(substr(key, 2) as bigint) % 4")).alias("community"))
    return graph.within_communities(edges, member).select("source", "target", "community")


@query(f"""WITH {MEMORIES} SELECT chat_id, id FROM mem WHERE contains(lower(coalesce(summary, '')), 'er') OR contains(lower(array_to_string(characters, ' ')), 'er') OR id % 10 = 3""")
def search_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have ``er`` in their text, their characters or their place."""
    mem = memories(spark, sf_dir).withColumn("location", F.when(F.col("id") % 10 == 3, F.lit("Rivers")))
    return reports.search(reports.filter_memories(mem), "ER").select("chat_id", "id")


@query()
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and their tokens of each chat by merging byte pairs; a vocabulary isn't there in SQL."""
    import public_tokenizers

    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "text")
    counted = tokens.with_counts(rows, "text", tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return counted.groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("n_tokens").alias("tokens"))


@query(f"""WITH {_LIKE_VEC}, n AS (SELECT chat_id, md5(id::VARCHAR) AS key, CASE WHEN id % 2 = 0 THEN 'OBJECT' ELSE 'PERSON' END AS type, e FROM lv WHERE turn = 0),
a AS (SELECT chat_id, CASE WHEN id % 3 = 0 THEN md5((id - 140 * turn)::VARCHAR) || ' two' ELSE md5(id::VARCHAR) END AS name, CASE WHEN id % 2 = 0 THEN 'OBJECT' ELSE 'PERSON' END AS type, e FROM lv WHERE turn <> 0),
p AS (SELECT a.chat_id, a.name, n.key, list_cosine_similarity(a.e, n.e) AS s, a.type, contains(a.name, n.key) AS named FROM a JOIN n ON n.chat_id = a.chat_id AND n.type = a.type),
m AS (SELECT chat_id, name, max((s, key)) AS m FROM p WHERE (type = 'PERSON' AND s >= 0.9) OR (s >= 0.8 AND named) GROUP BY ALL) SELECT chat_id, name, m[2] AS key, round(m[1], 6) AS s FROM m""".replace("max((s, key)) AS m", "max({'s': s, 'key': key}) AS m").replace("m[2]", "m.key").replace("m[1]", "m.s"))
def similar_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions as new entities: the first one that each may be merged with, people by vector alone, others by vector and name."""
    rows, i = _like(spark, sf_dir), F.col("id")
    kind = F.when(i % 2 == 0, "OBJECT").otherwise("PERSON").alias("type")
    nodes = rows.filter("turn = 0").select("chat_id", F.md5(i.cast("string")).alias("key"), kind, "embedding")
    name = F.when(i % 3 == 0, F.concat(F.md5((i - 140 * F.col("turn")).cast("string")), F.lit(" two"))).otherwise(F.md5(i.cast("string")))
    new = rows.filter("turn <> 0").select("chat_id", name.alias("name"), kind, "embedding").withColumn("own", F.col("name"))
    return rounded(graph.similar_nodes(new, nodes), "s")
