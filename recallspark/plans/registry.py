"""The library's registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import staging
from ..config import Settings
from ..functions import codec, language, text
from ..operators import access, communities, context, contradiction, dedup, graph, lexical, maintenance, ranking, reflection, reports, scheduling, scoring, selection
from ..sources import store
from ..streaming import batches, extraction, timed
from .tables import GRAPH, MEMORIES, MESSAGES, edge_parts, memories, messages, read, vectors
from .tables import graph as graph_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce(summary, '')), '[\p{{L}}0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOPS}, w))"
_CORPUS = f"""{MEMORIES}, tok AS (SELECT chat_id, id, {_TOKENS} AS t FROM mem),
corpus AS (SELECT chat_id, count(*) AS n_docs, avg(len(t)) AS avg_dl FROM tok GROUP BY chat_id),
post AS (SELECT chat_id, id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chat_id, id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY chat_id, id, term),
idf AS (SELECT p.chat_id, term, count(*) AS df, any_value(n_docs) AS n_docs FROM post p JOIN corpus c ON c.chat_id = p.chat_id GROUP BY p.chat_id, term),
idf2 AS (SELECT chat_id, term, df, n_docs, ln((n_docs - df + 0.5) / (df + 0.5) + 1) AS idf FROM idf)"""
_BM25 = """wt AS (
  SELECT query_id, i.chat_id, i.term, idf, greatest(1.0, floor(cnt * idf / ln(n_docs + 1.0) + 0.5)) AS m FROM qt JOIN idf2 i ON i.term = qt.term
), bm AS (
  SELECT query_id, p.chat_id, p.id, sum(m * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS bm25
  FROM post p JOIN wt w ON w.chat_id = p.chat_id AND w.term = p.term JOIN corpus c ON c.chat_id = p.chat_id GROUP BY ALL
)"""
_ITEMS = _TOKENS.replace("summary", "text")
_DECAY = """dist AS (SELECT *, (SELECT max(extraction_count) FROM mem) - extraction_count AS distance FROM mem),
rate AS (
  SELECT *, greatest(0.5, 1 / (1 + 0.1 * retrieval_hits)) AS damping,
         0.05 / (importance * importance) * greatest(0.5, 1 / (1 + 0.1 * retrieval_hits)) * CASE WHEN is_transient THEN 5.0 ELSE 1.0 END AS lambda_
  FROM dist
), base AS (
  SELECT *, CASE WHEN importance = 5 THEN greatest(importance * exp(-lambda_ * distance), 1.0) ELSE importance * exp(-lambda_ * distance) END AS base_after_floor,
         1 + ln(mentions) * 0.05 AS frequency,
         CASE WHEN type = 'reflection' AND distance > 750 THEN greatest(0.25, 1 - (distance - 750) / (1500 * pow(2.0, level - 1))) ELSE 1.0 END AS reflection
  FROM rate
)"""


def _distance(mem: DataFrame) -> DataFrame:
    now = mem.agg(F.max("extraction_count").alias("now"))
    return mem.withColumn("distance", F.lit(now.first()[0] or 0) - F.col("extraction_count"))


def _corpus(spark: SparkSession, sf_dir: str, terms: DataFrame | None = None, stem=None):
    """(memories, postings, corpus sizes, idf): the terms of all memories are written once, and the sizes sent to every task where there are few chats."""
    mem = memories(spark, sf_dir)
    told = staging.written(lexical.tokenized(mem, stem), "tokens")
    posted, corpus = lexical.postings(told, terms), staging.small(staging.written(lexical.corpus_size(told).coalesce(1), "corpus"))
    return mem, posted, corpus, lexical.idf_table(posted, corpus)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = _distance(memories(spark, sf_dir)).withColumns({"query_id": F.lit(0), "bm25_norm": F.lit(0.0), "similarity": F.lit(None).cast("double")})
    return scoring.score(mem)


# ---- lexical retrieval and scoring


_VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), nv AS (SELECT count(*) AS n FROM embeddings)"


@query(f"""WITH {_CORPUS}, {_VEC}, q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, term, count(*) AS cnt FROM (SELECT query_id, unnest({_ITEMS}) AS term FROM q) GROUP BY ALL), {_BM25}, {_DECAY},
mx AS (SELECT query_id, chat_id, greatest(max(bm25), 1e-9) AS top FROM bm GROUP BY ALL),
s AS (
  SELECT q.query_id, b.chat_id, b.id, b.ord, base_after_floor, frequency, 0.3 * 15.0 * coalesce(bm25 / top, 0) AS bonus, reflection, list_cosine_similarity(a.e, c.e) AS sim
  FROM base b CROSS JOIN q CROSS JOIN nv LEFT JOIN v a ON a.id = q.query_id % n LEFT JOIN v c ON c.id = b.id % n
  LEFT JOIN bm ON bm.query_id = q.query_id AND bm.chat_id = b.chat_id AND bm.id = b.id LEFT JOIN mx ON mx.query_id = q.query_id AND mx.chat_id = b.chat_id WHERE NOT archived
), f AS (SELECT *, (base_after_floor + bonus) * frequency * reflection AS fast FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chat_id ORDER BY fast DESC, ord) AS r FROM f),
t AS (SELECT *, round(CASE WHEN r <= 200 AND sim > 0.1 THEN (base_after_floor + bonus + 0.7 * 15.0 * (sim - 0.1) / 0.9) * frequency ELSE fast END, 9) AS score FROM r)
SELECT query_id, chat_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chat_id ORDER BY score DESC, ord) AS rank FROM t) WHERE rank <= 20""")
def retrieval_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best memories of each chat for every benchmark item with an id divisible by 20: BM25, decay, frequency and vectors, in two passes."""
    return _ranked(spark, sf_dir, None)


@query()
def retrieval_rank_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with words reduced to their stems, as SQL can't."""
    return _ranked(spark, sf_dir, language.stems)


def _ranked(spark: SparkSession, sf_dir: str, stem) -> DataFrame:
    items = _items(spark, sf_dir).filter("query_id % 20 = 0")
    terms = lexical.query_terms(items, stem)
    mem, posted, corpus, idf = _corpus(spark, sf_dir, terms, stem)
    bm25 = staging.written(lexical.bm25(lexical.weigh_terms(terms, idf, corpus), posted, corpus), "bm25")
    hits = lexical.normalized(bm25).select("query_id", "chat_id", "id", "bm25_norm")
    table, n = _vectors(spark, sf_dir)
    rows = _distance(maintenance.active(mem.drop("summary"))).withColumn("vec_id", F.col("id") % n)
    asked = items.select("query_id").join(corpus.select("chat_id"), F.lit(True))
    near = items.select("query_id", (F.col("query_id") % n).alias("vec_id")).join(table, "vec_id").select("query_id", F.col("embedding").alias("query_vector"))
    scored = scoring.score_late(rows, hits, asked, table, near, 20, Settings(vector_threshold=0.1)).withColumn("score", F.round("score", 9))
    return rounded(scoring.best(scored, 20).select("query_id", "chat_id", "id", "score", F.col("rank").cast("long").alias("rank")), "score")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding of every vector; how many there are)."""
    table = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), "embedding")
    return table, table.count()


@query(f"WITH {_CORPUS} SELECT chat_id, term, df, round(idf, 6) AS idf FROM idf2")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every term of each chat."""
    return rounded(_corpus(spark, sf_dir)[3], "idf")


@query(f"""WITH {_CORPUS}, qt AS (SELECT query_id, term, count(*) AS cnt FROM (SELECT item_id AS query_id, unnest({_ITEMS}) AS term FROM benchmark) GROUP BY ALL), {_BM25}
SELECT query_id, chat_id, id, round(round(bm25, 9), 6) AS bm25, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chat_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm) WHERE rank <= 5""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the five best memories of each chat by BM25."""
    terms = lexical.query_terms(_items(spark, sf_dir))
    _, posted, corpus, idf = _corpus(spark, sf_dir, terms)
    found = lexical.bm25(lexical.weigh_terms(terms, idf, corpus), posted, corpus).withColumn("bm25", F.round("bm25", 9))
    best = ranking.top_n(found, ["query_id", "chat_id"], [F.desc("bm25"), F.col("id")], 5)
    return rounded(best.withColumn("rank", F.col("rank").cast("long")), "bm25")


@query(f"""WITH {_CORPUS}, qt AS (SELECT item_id AS query_id, unnest(list_distinct({_ITEMS})) AS term FROM benchmark)
SELECT query_id, term, CASE WHEN term IN (SELECT term FROM post) THEN 3 ELSE 2 END::BIGINT AS count FROM qt""")
def query_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the benchmark items by tier: those that the corpus has count more."""
    return lexical.tiered_terms(lexical.query_terms(_items(spark, sf_dir)), lexical.vocabulary(memories(spark, sf_dir)))


@query(f"WITH {MEMORIES}, {_DECAY} SELECT id, round(damping, 6) AS damping, round(base_after_floor, 6) AS base, round(0.6931471805599453 / lambda_, 6) AS half_life, "
       "round(greatest(0.0, 3 * (0.6931471805599453 / lambda_) - distance), 6) AS remaining FROM base")
def decay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay of every memory: damping by hits, floored base, half-life and what is left of it."""
    mem, distance = _distance(memories(spark, sf_dir)), F.col("distance")
    parts, life = scoring.decay(distance), scoring.half_life(distance)
    return rounded(mem.select("id", parts["damping"].alias("damping"), parts["floored"].alias("base"), life["half_life"].alias("half_life"), life["remaining"].alias("remaining")), "damping", "base", "half_life", "remaining")


@query(f"""WITH {_VEC}, s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS similarity FROM v q JOIN v ON true WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS place FROM s WHERE round(similarity, 9) >= 0.2)
SELECT query_id, id, round(similarity, 6) AS similarity, place, round(CASE WHEN n <= 1 THEN 1.0 ELSE 1 - (place - 1) / (n - 1)::DOUBLE * 0.5 END, 6) AS proxy
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE place <= 10)""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each query; queries are the vectors with an id divisible by 20."""
    table = vectors(spark, sf_dir)
    queries = table.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = scoring.nearest(table, queries, 10, 0.2)
    return rounded(found.select("query_id", "id", "similarity", F.col("place").cast("long").alias("place"), "proxy"), "similarity", "proxy")


@query(f"""WITH {MEMORIES}, {_DECAY}, {_VEC},
f AS (SELECT b.*, (base_after_floor * frequency * reflection) AS fast, row_number() OVER (PARTITION BY chat_id ORDER BY base_after_floor * frequency * reflection DESC, ord) AS r FROM base b),
s AS (SELECT f.*, q.id AS query_id, list_cosine_similarity(v.e, q.e) AS sim FROM f CROSS JOIN nv LEFT JOIN v ON v.id = f.id % n CROSS JOIN v q WHERE q.id % 20 = 0)
SELECT query_id, chat_id, id, round(CASE WHEN r <= 200 AND sim > 0.05 THEN 0.7 * 15.0 * (sim - 0.05) / 0.95 ELSE 0 END, 6) AS vector_bonus,
       round(CASE WHEN r <= 200 AND sim > 0.05 THEN (base_after_floor + 0.7 * 15.0 * (sim - 0.05) / 0.95) * frequency ELSE fast END, 6) AS score FROM s""")
def two_pass_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all memories for every query vector (ids divisible by 20): only the 200 best of a chat after the first pass get the vector bonus."""
    table, n = _vectors(spark, sf_dir)
    queries = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    mem = _distance(memories(spark, sf_dir).drop("summary")).withColumn("vec_id", F.col("id") % n)
    asked = mem.select("chat_id").distinct().join(F.broadcast(queries.select("query_id")), F.lit(True))
    hits = asked.select("query_id", "chat_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("bm25_norm")).limit(0)
    scored = scoring.score_late(mem, hits, asked, table, queries, None, Settings(vector_threshold=0.05), 6)
    return scored.select("query_id", "chat_id", "id", "vector_bonus", "score")


# ---- selection

_FAST = f"""{MEMORIES}, {_DECAY}, len AS (SELECT chat_id, max(extraction_count) AS n FROM mem GROUP BY chat_id),
sc AS (
  SELECT b.chat_id, b.id, b.ord, b.importance, round(base_after_floor * frequency * reflection, 9) AS score, CAST(ceil(length(coalesce(summary, '')) / 4.0) AS BIGINT) AS n_tokens,
         CASE WHEN b.extraction_count >= greatest(0, n - 100) THEN 'recent' WHEN b.extraction_count >= greatest(0, n - 500) THEN 'mid' ELSE 'old' END AS bucket
  FROM base b JOIN len ON len.chat_id = b.chat_id
)"""


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("score", F.round("score", 9))
    length = scored.groupBy("chat_id").agg(F.max("extraction_count").alias("n"))
    rows = scored.join(length, "chat_id").withColumn("bucket", selection.bucket(F.col("extraction_count"), F.col("n")))
    return rows.select("query_id", "chat_id", "id", "ord", "importance", "score", text.token_count(F.col("summary")).alias("n_tokens"), "bucket", "extraction_count", "summary")


_BALANCE = f"""{_FAST}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY score DESC, ord) AS r FROM sc) WHERE r <= 1000),
p1 AS (SELECT * FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY chat_id, bucket ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS u FROM top) WHERE u <= 4000 * 0.2),
used AS (SELECT chat_id, sum(n_tokens) AS t FROM p1 GROUP BY chat_id),
p2 AS (SELECT * FROM (SELECT top.*, coalesce(t, 0) AS t, sum(n_tokens) OVER (PARTITION BY top.chat_id ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS u
       FROM top LEFT JOIN used ON used.chat_id = top.chat_id WHERE top.id NOT IN (SELECT id FROM p1)) WHERE u <= 4000 - t),
sel AS (SELECT chat_id, id, ord, importance, score, n_tokens, bucket, 1 AS phase FROM p1 UNION ALL SELECT chat_id, id, ord, importance, score, n_tokens, bucket, 2 FROM p2)"""


@query(f"WITH {_BALANCE} SELECT chat_id, id, bucket, n_tokens, phase FROM sel")
def soft_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of each chat under 4,000 tokens: a fifth for each age first, then the best of the rest."""
    top = scoring.best(_bucketed(spark, sf_dir), 1000)
    return selection.soft_balance(top, 4000).select("chat_id", "id", "bucket", "n_tokens", "phase")


@query(f"""WITH {_BALANCE}, ranked AS (SELECT *, CASE WHEN importance = 5 THEN row_number() OVER (PARTITION BY chat_id, importance = 5 ORDER BY score DESC, ord) ELSE 0 END AS k FROM sel),
kept AS (SELECT * FROM ranked WHERE k <= 2), ku AS (SELECT chat_id, sum(n_tokens) AS t FROM kept GROUP BY chat_id),
fill AS (SELECT * FROM (SELECT top.*, coalesce(t, 0) AS t, sum(n_tokens) OVER (PARTITION BY top.chat_id ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS u
         FROM top LEFT JOIN ku ON ku.chat_id = top.chat_id
         WHERE importance <> 5 AND top.id NOT IN (SELECT id FROM sel) AND top.chat_id IN (SELECT chat_id FROM ranked WHERE k > 2)) WHERE u <= 4000 - t)
SELECT chat_id, id, importance, phase FROM kept UNION ALL SELECT chat_id, id, importance, 3 FROM fill""")
def importance_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced selection with two memories of importance 5 at most; the room they leave is filled."""
    top = scoring.best(_bucketed(spark, sf_dir), 1000)
    chosen = selection.soft_balance(top, 4000)
    return selection.cap_importance(chosen, top, 4000).select("chat_id", "id", F.col("importance").cast("long").alias("importance"), "phase")


@query(f"""WITH {MEMORIES}, m AS (SELECT *, CAST(ceil(length(coalesce(summary, '')) / 4.0) AS BIGINT) AS nt FROM mem), pool AS (SELECT * FROM m WHERE nt > 0),
r AS (SELECT * FROM (SELECT *, sum(nt) OVER (PARTITION BY chat_id ORDER BY sequence DESC, ord ROWS UNBOUNDED PRECEDING) AS u FROM pool) WHERE u <= 1000),
h AS (SELECT * FROM (SELECT *, sum(nt) OVER (PARTITION BY chat_id ORDER BY importance DESC, sequence DESC, ord ROWS UNBOUNDED PRECEDING) AS u
      FROM pool WHERE importance >= 4 AND id NOT IN (SELECT id FROM r)) WHERE u <= 3000),
hu AS (SELECT chat_id, sum(nt) AS t FROM h GROUP BY chat_id),
f AS (SELECT * FROM (SELECT p.*, coalesce(t, 0) AS t, sum(nt) OVER (PARTITION BY p.chat_id ORDER BY sequence DESC, ord ROWS UNBOUNDED PRECEDING) AS u
      FROM pool p LEFT JOIN hu ON hu.chat_id = p.chat_id WHERE id NOT IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM h)) WHERE u <= 3000 - t)
SELECT chat_id, id, 'recent' AS step FROM r UNION ALL SELECT chat_id, id, 'important' FROM h UNION ALL SELECT chat_id, id, 'fill' FROM f""")
def rearview_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extraction is shown of each chat's past within 4,000 tokens."""
    mem = memories(spark, sf_dir).withColumn("n_tokens", text.token_count(F.col("summary")))
    return selection.rearview(mem, 4000).select("chat_id", "id", "step")


@query(f"""WITH {_FAST} SELECT chat_id, coalesce(sum(n_tokens) FILTER (bucket = 'old'), 0)::BIGINT AS old, coalesce(sum(n_tokens) FILTER (bucket = 'mid'), 0)::BIGINT AS mid,
coalesce(sum(n_tokens) FILTER (bucket = 'recent'), 0)::BIGINT AS recent FROM sc GROUP BY chat_id""")
def bucket_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each chat's memories by age."""
    return selection.bucket_tokens(_bucketed(spark, sf_dir))


# ---- access and contradictions


@query(f"WITH {MEMORIES} SELECT chat_id, id FROM mem WHERE list_has_any(characters, ['c1', 'c3']) OR id % 50 = 7")
def pov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that c1, also known as c3, can know."""
    mem = memories(spark, sf_dir).withColumn("witnesses", F.slice("characters", 1, 1))
    chats = mem.select("chat_id").distinct()
    viewers = chats.select("chat_id", F.lit("C1").alias("name"))
    nodes = chats.select("chat_id", F.lit("C1").alias("name"), F.array(F.lit("C3")).alias("aliases"))
    known = mem.filter("id % 50 = 7").select("chat_id", "id")
    return access.visible(mem, access.expand_names(viewers, nodes), known).select("chat_id", "id")


def _mood_sql() -> str:
    def list_(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    def count(words, phrases):
        said = f"list_filter(range(1, len(t) + 1), lambda i: list_contains({list_(words)}, t[i]))"
        one = f"len(list_filter({said}, lambda i: NOT list_has_any(t[greatest(1, i - 3):i - 1], {list_(contradiction.NEGATORS)})))"
        pad = "' ' || array_to_string(t, ' ') || ' '"
        more = "".join(
            f" + CASE WHEN strpos({pad}, ' {p} ') > 0 AND NOT list_has_any(list_filter(string_split(trim(left({pad}, strpos({pad}, ' {p} ')::INT)), ' '), lambda w: w <> '')[-3:], {list_(contradiction.NEGATORS)}) THEN 1 ELSE 0 END"
            for p in phrases
        )
        return one + more

    good, bad = count(contradiction.POSITIVE, contradiction.POSITIVE_PHRASES), count(contradiction.NEGATIVE, contradiction.NEGATIVE_PHRASES)
    return rf"""tk AS (SELECT *, regexp_extract_all(lower(coalesce(summary, '')), '[\p{{L}}0-9_]+') AS t FROM mem),
cnt AS (SELECT *, {good} AS good, {bad} AS bad FROM tk),
mood AS (SELECT *, CASE WHEN good > 0 AND bad = 0 THEN 'positive' WHEN bad > 0 AND good = 0 THEN 'negative' ELSE 'neutral' END AS mood FROM cnt)"""


@query(f"WITH {MEMORIES}, {_mood_sql()} SELECT id, mood FROM mood")
def sentiment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of every memory."""
    return memories(spark, sf_dir).select("id", contradiction.sentiment(F.col("summary")).alias("mood"))


_INSULTS = """mem2 AS (SELECT * REPLACE (CASE WHEN regexp_matches(lower(coalesce(summary, '')), '(^|[^a-z])(idiot|scum|trash)([^a-z]|$)') THEN 'they hate each other'
  WHEN regexp_matches(lower(coalesce(summary, '')), '(^|[^a-z])erth([^a-z]|$)') THEN 'they are friends' ELSE summary END AS summary) FROM mem)"""


@query(f"""WITH {MEMORIES}, {_INSULTS}, {_mood_sql().replace("FROM mem)", "FROM mem2)")},
g AS (SELECT chat_id, id, mood, extraction_count AS tm, array_to_string(list_sort(list_transform(characters, lambda c: trim(lower(c)))), '|') AS grp FROM mood WHERE mood <> 'neutral'),
n AS (SELECT chat_id, grp, max(tm) FILTER (mood = 'positive') AS p, max(tm) FILTER (mood = 'negative') AS q FROM g GROUP BY ALL)
SELECT g.chat_id, id FROM g JOIN n ON n.chat_id = g.chat_id AND n.grp = g.grp WHERE (p > q AND mood = 'negative') OR (q > p AND mood = 'positive')""")
def contradiction_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that a newer one about the same characters overrules; texts with certain words are told as hostile or friendly."""
    low = F.lower(F.coalesce("summary", F.lit("")))
    told = F.when(low.rlike("(^|[^a-z])(idiot|scum|trash)([^a-z]|$)"), "they hate each other").when(low.rlike("(^|[^a-z])erth([^a-z]|$)"), "they are friends")
    return contradiction.contradicted(memories(spark, sf_dir).withColumn("summary", F.coalesce(told, "summary")))


@query(f"""WITH {MEMORIES}, a AS (SELECT chat_id, id, list_sort(list_distinct(characters)) AS c FROM mem)
SELECT chat_id, c[1] AS first, c[2] AS second, count(*) AS n FROM a WHERE len(c) = 2 GROUP BY ALL""")
def character_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories each pair of characters shares."""
    return contradiction.character_pairs(memories(spark, sf_dir)).groupBy("chat_id", "first", "second").agg(F.count(F.lit(1)).alias("n"))


# ---- similar memories

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(summary, '')), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2))"


_CLASSES = f"""w AS (SELECT chat_id, id, {_WORDS} AS w FROM mem),
cl AS (SELECT *, min(id) OVER (PARTITION BY chat_id, list_sort(w), CASE WHEN len(w) = 0 THEN id END) AS rep FROM w)"""


@query(f"""WITH {MEMORIES}, {_CLASSES}, c AS (SELECT * FROM cl WHERE id = rep),
p AS (SELECT a.chat_id, a.id AS l, b.id AS r, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM c a JOIN c b ON a.chat_id = b.chat_id AND a.id < b.id)
SELECT chat_id, l, r, i / (n + m - i)::DOUBLE AS similarity FROM p WHERE i > 0 AND i / (n + m - i)::DOUBLE >= 0.6""")
def similar_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories of a chat with different word sets of a Jaccard similarity of 0.6 or more; of those with equal sets the first stands for all (``same_words``)."""
    classes = dedup.word_classes(memories(spark, sf_dir)).filter("id = rep").select("chat_id", "id", "words")
    return dedup.shared_word_candidates(classes, None, 0.6)


@query(f"WITH {MEMORIES}, {_CLASSES} SELECT chat_id, id, rep FROM cl")
def same_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every memory the first one of its chat with the same words."""
    return dedup.word_classes(memories(spark, sf_dir)).select("chat_id", "id", "rep")


@query(f"""WITH RECURSIVE {MEMORIES}, w AS (SELECT chat_id, id, ord, {_WORDS} AS w, row_number() OVER (PARTITION BY chat_id ORDER BY ord, id) AS rn FROM mem),
p AS (SELECT a.chat_id, a.rn AS l, b.rn AS r, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM w a JOIN w b ON a.chat_id = b.chat_id AND a.rn < b.rn),
e AS (SELECT chat_id, r, list(l) AS earlier FROM p WHERE i > 0 AND i / (n + m - i)::DOUBLE >= 0.6 GROUP BY chat_id, r),
x AS (SELECT w.chat_id, w.rn, coalesce(earlier, []) AS earlier FROM w LEFT JOIN e ON e.chat_id = w.chat_id AND e.r = w.rn),
s AS (SELECT chat_id, rn, [rn] AS kept FROM x WHERE rn = 1
  UNION ALL SELECT x.chat_id, x.rn, CASE WHEN list_has_any(s.kept, x.earlier) THEN s.kept ELSE list_append(s.kept, x.rn) END FROM s JOIN x ON x.chat_id = s.chat_id AND x.rn = s.rn + 1),
f AS (SELECT chat_id, unnest(kept) AS rn FROM (SELECT chat_id, arg_max(kept, rn) AS kept FROM s GROUP BY chat_id))
SELECT w.chat_id, w.id FROM w JOIN f ON f.chat_id = w.chat_id AND f.rn = w.rn""")
def dedup_within_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that stay when each is dropped that resembles an earlier one that stays."""
    return dedup.within_batch(memories(spark, sf_dir)).select("chat_id", "id")


@query(rf"""WITH {MEMORIES}, w AS (SELECT chat_id, id, type, characters, row_number() OVER (PARTITION BY chat_id ORDER BY extraction_count, ord) AS rn,
  list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(summary, '')), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: length(x) > 2)) AS w FROM mem),
p AS (SELECT a.chat_id, a.id AS first, b.id AS second, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m,
      len(list_intersect(a.characters, b.characters)) AS ci, len(list_distinct(list_concat(a.characters, b.characters))) AS cu
      FROM w a JOIN w b ON a.chat_id = b.chat_id AND a.type = b.type AND b.rn BETWEEN a.rn + 1 AND a.rn + 14)
SELECT chat_id, first, second, i / (n + m - i)::DOUBLE AS overlap FROM p
WHERE n > 0 AND m > 0 AND i / (n + m - i)::DOUBLE >= 0.05 AND i / (n + m - i)::DOUBLE < 0.6 AND ci / cu::DOUBLE >= 0.3""")
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring memories that share some words but not most: pairs for a second look."""
    return dedup.review_pairs(memories(spark, sf_dir).withColumn("message_id", F.col("extraction_count")), low=0.05)


# ---- graph


def _even_customers(nodes: DataFrame) -> DataFrame:
    """from_key, to_key: customers of an even number and the one before each."""
    number = F.expr("cast(substr(key, 2) as bigint)")
    return nodes.filter("type = 'PERSON'").filter((number % 2 == 0) & (number > 1)).select(F.col("key").alias("from_key"), F.concat(F.lit("c"), (number - 1).cast("string")).alias("to_key"))


def _chat(df: DataFrame) -> DataFrame:
    return df.withColumn("chat_id", F.lit("shop"))


@query(f"""WITH {GRAPH}, u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(weight)::DOUBLE AS w FROM edge GROUP BY ALL)
SELECT a, b, round(CASE WHEN a LIKE 'n%' OR b LIKE 'n%' THEN w * 0.05 ELSE w END, 6) AS weight FROM u""")
def graph_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order graph without directions; edges of nations, its hubs, are made light."""
    nodes, edges = graph_tables(spark, sf_dir)
    hubs = _chat(nodes.filter("type = 'PLACE'").select("key"))
    return rounded(graph.undirected(_chat(edges), hubs).select("a", "b", "weight"), "weight")


@query(f"""WITH {GRAPH}, ch AS (SELECT key FROM node WHERE type = 'PERSON'), b AS (SELECT source AS k, target AS o, weight FROM edge UNION ALL SELECT target, source, weight FROM edge)
SELECT o AS key, sum(weight)::BIGINT AS weight FROM b WHERE k IN (FROM ch) AND o NOT IN (FROM ch) GROUP BY o""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies one step from the customers."""
    nodes, edges = graph_tables(spark, sf_dir)
    return graph.neighbours(_chat(edges), _chat(nodes.filter("type = 'PERSON'").select("key"))).select("key", "weight")


@query(f"WITH {GRAPH} SELECT n.type, n.nodes, coalesce(e.edges, 0) AS edges FROM (SELECT type, count(*) AS nodes FROM node GROUP BY type) n "
       "LEFT JOIN (SELECT type, count(*) AS edges FROM edge JOIN node ON key = source GROUP BY type) e ON e.type = n.type")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return reports.graph_summary(_chat(nodes), _chat(edges)).select("type", "nodes", "edges")


@query(f"""WITH {GRAPH}, b AS (SELECT source AS key, weight FROM edge UNION ALL SELECT target, weight FROM edge)
SELECT key, sum(weight)::BIGINT AS weight FROM b GROUP BY key ORDER BY weight DESC, key LIMIT 10""")
def graph_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes with the greatest weight of edges."""
    return reports.strongest_nodes(_chat(graph_tables(spark, sf_dir)[1])).select("key", "weight")


@query(f"""WITH {GRAPH}, m AS (SELECT key AS f, 'c' || (substr(key, 2)::BIGINT - 1) AS t FROM node WHERE key LIKE 'c%' AND substr(key, 2)::BIGINT % 2 = 0 AND substr(key, 2)::BIGINT > 1),
e AS (SELECT coalesce(a.t, source) AS s, coalesce(b.t, target) AS g, weight FROM edge LEFT JOIN m a ON a.f = source LEFT JOIN m b ON b.f = target)
SELECT s AS source, g AS target, sum(weight)::BIGINT AS weight FROM e WHERE s <> g GROUP BY ALL""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order graph's edges after every customer of an even number is merged into the one before."""
    nodes, edges = graph_tables(spark, sf_dir)
    full = _chat(nodes).withColumns({"description": F.col("type"), "mentions": F.lit(1), "aliases": F.array().cast("array<string>")})
    return graph.merge_nodes(full, _chat(edges), _chat(_even_customers(nodes)), edge_parts(spark, sf_dir))[1].select("source", "target", "weight")


@query(f"""WITH {GRAPH}, m AS (SELECT key, CASE WHEN key LIKE 'c%' AND substr(key, 2)::BIGINT % 2 = 0 AND substr(key, 2)::BIGINT > 1 THEN 'c' || (substr(key, 2)::BIGINT - 1) ELSE key END AS t, name, type FROM node)
SELECT t AS key, any_value(name) FILTER (key = t) AS name, 'about ' || any_value(type) AS description, count(*) AS mentions,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (key <> t), '') AS aliases, count(*) > 1 AS stale_vector FROM m GROUP BY t""")
def entity_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order graph's nodes after the same merge: mentions added up, names kept as aliases, like descriptions once."""
    nodes, edges = graph_tables(spark, sf_dir)
    full = _chat(nodes).withColumns({"description": F.concat(F.lit("about "), F.col("type")), "mentions": F.lit(1), "aliases": F.array().cast("array<string>")})
    merged = graph.merge_nodes(full, _chat(edges), _chat(_even_customers(nodes)))[0]
    return merged.select("key", "name", "description", "mentions", F.array_join("aliases", ",").alias("aliases"), "stale_vector")


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS f, p_partkey // 3 AS t, 1 AS d FROM part WHERE p_partkey >= 3
  UNION ALL SELECT f, t // 3, d + 1 FROM r WHERE t >= 3 AND d < 10)
SELECT 'p' || f AS from_key, 'p' || min(t) AS to_key FROM r GROUP BY f""")
def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of redirects between parts end."""
    k = F.col("p_partkey")
    parts = read(spark, sf_dir, "part").filter(k >= 3).select(F.concat(F.lit("p"), k.cast("string")).alias("from_key"), F.concat(F.lit("p"), F.floor(k / 3).cast("string")).alias("to_key"))
    return graph.resolve_redirects(_chat(parts)).select("from_key", "to_key")


@query()
def trade_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of nations by who buys from whom."""
    customer, supplier, orders, lineitem = (read(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    # nations are known where an order or a line is read, so a line is shuffled once, to meet its order
    buys = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sells = lineitem.join(staging.small(supplier.select("s_suppkey", "s_nationkey"), 1_000_000), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    pairs = sells.join(buys, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("weight"))
    edges = pairs.select(F.concat(F.lit("b"), "c_nationkey").alias("source"), F.concat(F.lit("s"), "s_nationkey").alias("target"), "weight")
    return communities.detect(graph.undirected(_chat(edges))).select("key", "community")


@query("""WITH e AS (SELECT o_custkey, l_suppkey, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT c_nationkey AS a, s_nationkey AS b, w FROM e JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
d AS (SELECT a AS n, w FROM g UNION ALL SELECT b, w FROM g), v AS (SELECT n, sum(w) AS k FROM d GROUP BY n), t AS (SELECT sum(w) AS m FROM g)
SELECT round((SELECT sum(w) FROM g WHERE a = b) / m - (SELECT sum(pow(k / (2.0 * m), 2)) FROM v, t), 9) AS modularity FROM t""")
def nation_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well nations part the customers and suppliers who trade with each other."""
    customer, supplier, orders, lineitem = (read(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight"))
    edges = _chat(rows.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), "weight"))
    member = customer.select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_nationkey").alias("community"))
    member = _chat(member.unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_nationkey").alias("community"))))
    return communities.modularity(edges, member).select(F.round("modularity", 9).alias("modularity"))


# ---- reflections and characters


@query(f"""WITH {MEMORIES}, p AS (SELECT chat_id, importance, unnest(list_distinct(characters)) AS character FROM mem)
SELECT chat_id, character, sum(importance)::BIGINT AS importance_sum FROM p GROUP BY ALL HAVING sum(importance) >= 40""")
def reflection_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters whose memories weigh enough for a reflection."""
    return reflection.due(reflection.accumulate(memories(spark, sf_dir).withColumn("witnesses", F.slice("characters", 1, 1))))


@query(f"""WITH {MEMORIES}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, character ORDER BY sequence DESC, ord DESC) AS k, count(*) OVER (PARTITION BY chat_id, character) AS n FROM mem)
SELECT chat_id, id FROM r WHERE n >= 4 AND k > 3""")
def reflection_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts beyond the newest of each character, at a cap of four."""
    return reflection.over_cap(memories(spark, sf_dir), 4)


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS emotion, count(*) AS n FROM events GROUP BY user_id""")
def character_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as its state."""
    events = read(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("emotion"), F.count(F.lit(1)).alias("n"))


# ---- messages

_LOG = f"{MESSAGES}, log AS (SELECT * FROM msg WHERE NOT is_system)"


@query(f"""WITH {_LOG}, l AS (SELECT chat_id, max(idx) AS latest FROM msg GROUP BY chat_id)
SELECT log.chat_id, idx FROM log JOIN l ON l.chat_id = log.chat_id WHERE idx < latest AND idx % 3 <> 0""")
def unprocessed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages still to process where every third is done."""
    log = messages(spark, sf_dir)
    return scheduling.unprocessed(log, log.filter("idx % 3 = 0")).select("chat_id", "idx")


@query(f"""WITH {_LOG}, t AS (SELECT chat_id, NOT is_user AND coalesce(lag(is_user) OVER (PARTITION BY chat_id ORDER BY idx), false) AS turn FROM log)
SELECT chat_id, sum(turn::INT)::BIGINT AS turns FROM t GROUP BY chat_id""")
def turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.turns(messages(spark, sf_dir))


@query(f"""WITH {_LOG}, t AS (SELECT *, NOT is_user AND coalesce(lead(is_user) OVER (PARTITION BY chat_id ORDER BY idx), true) AS b FROM log),
e AS (SELECT chat_id, max(idx) AS last FROM t WHERE b GROUP BY chat_id)
SELECT msg.chat_id, idx FROM msg JOIN e ON e.chat_id = msg.chat_id WHERE idx <= last""")
def turn_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each chat up to its last whole turn."""
    return scheduling.snap(messages(spark, sf_dir)).select("chat_id", "idx")


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT chat_id, idx, n_tokens, row_number() OVER (PARTITION BY chat_id ORDER BY idx) AS rn FROM log),
r AS (
  SELECT chat_id, idx, rn, CASE WHEN n_tokens >= 150 THEN 0 ELSE n_tokens END AS s, 0 AS batch, CASE WHEN n_tokens >= 150 THEN 1 ELSE 0 END AS next FROM o WHERE rn = 1
  UNION ALL
  SELECT o.chat_id, o.idx, o.rn, CASE WHEN r.s + o.n_tokens >= 150 THEN 0 ELSE r.s + o.n_tokens END, r.next, r.next + CASE WHEN r.s + o.n_tokens >= 150 THEN 1 ELSE 0 END
  FROM r JOIN o ON o.chat_id = r.chat_id AND o.rn = r.rn + 1
)
SELECT chat_id, idx, batch FROM r""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of about 150 tokens of each chat."""
    return scheduling.token_batches(messages(spark, sf_dir), 150)


@query(f"""WITH {_LOG}, w AS (SELECT *, sum(n_tokens) OVER (PARTITION BY chat_id) - 200 AS et, count(*) OVER (PARTITION BY chat_id) - 4 AS er,
  coalesce(sum(n_tokens) OVER (PARTITION BY chat_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bt,
  count(*) OVER (PARTITION BY chat_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS br FROM log)
SELECT chat_id, idx, n_tokens FROM w WHERE bt < et OR br < er""")
def auto_hide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest messages that must go until each chat has 200 tokens and four messages."""
    return scheduling.to_hide(messages(spark, sf_dir), 200, 4)


@query(f"""WITH {MESSAGES}, c AS (SELECT chat_id, idx AS ord, idx + 1 AS count, coalesce(lag(idx + 1) OVER (PARTITION BY chat_id ORDER BY idx), 0) AS last FROM msg)
SELECT chat_id, ord, count FROM c WHERE count // 3 > last // 3""")
def interval_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chat's message count passes a multiple of three."""
    return scheduling.crossed(messages(spark, sf_dir).select("chat_id", F.col("idx").alias("ord"), (F.col("idx") + 1).alias("count")), 3)


@query(f"""WITH {_LOG} SELECT chat_id, count(*) AS total, count(*) FILTER (idx % 2 = 0) AS extracted, count(*) FILTER (idx % 2 <> 0) AS unextracted,
coalesce(sum(n_tokens) FILTER (idx % 2 <> 0), 0)::BIGINT AS tokens_left FROM log GROUP BY chat_id""")
def extraction_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = messages(spark, sf_dir)
    return scheduling.progress(log, log.filter("idx % 2 = 0"))


@query(f"""WITH {MESSAGES}, n AS (SELECT *, coalesce(is_user <> lag(is_user) OVER (PARTITION BY chat_id ORDER BY idx), true)::INT AS new FROM msg),
r AS (SELECT *, sum(new) OVER (PARTITION BY chat_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT chat_id, run::BIGINT AS run, any_value(is_user) AS is_user, min(idx) AS start, max(idx) AS "end", count(*) AS n FROM r GROUP BY chat_id, run""")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each chat in which one side speaks."""
    return reports.runs(messages(spark, sf_dir).withColumn("ord", F.col("idx")), "is_user")


@query(f"""WITH {MESSAGES}, m AS (SELECT chat_id, idx AS id, [fingerprint, 'x'] AS fps FROM msg)
SELECT m.chat_id, m.id FROM m JOIN msg ON msg.chat_id = m.chat_id AND msg.idx = m.id WHERE is_system""")
def hidden_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories whose source message is a system row."""
    log = messages(spark, sf_dir)
    mem = log.select("chat_id", F.col("idx").alias("id"), F.array("fingerprint", F.lit("x")).alias("fingerprints"), F.array("idx").alias("message_ids"))
    return access.on_hidden_messages(mem, log).select("chat_id", "id")


_BATCHES = f"""WITH RECURSIVE {MESSAGES}, log AS (SELECT * FROM msg WHERE NOT is_system),
o AS (SELECT chat_id, idx, n_tokens, row_number() OVER w AS rn, NOT is_user AND coalesce(lead(is_user) OVER w, false) AS ends FROM log WINDOW w AS (PARTITION BY chat_id ORDER BY idx)),
r AS (
  SELECT chat_id, idx, rn, n_tokens, n_tokens AS s, 0 AS batch, ends AND n_tokens >= 150 AS hit FROM o WHERE rn = 1
  UNION ALL
  SELECT o.chat_id, o.idx, o.rn, o.n_tokens, CASE WHEN r.hit THEN 0 ELSE r.s END + o.n_tokens, r.batch + r.hit::INT,
         o.ends AND CASE WHEN r.hit THEN 0 ELSE r.s END + o.n_tokens >= 150
  FROM r JOIN o ON o.chat_id = r.chat_id AND o.rn = r.rn + 1
)
SELECT chat_id, batch::BIGINT AS batch, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS messages, sum(n_tokens)::BIGINT AS tokens
FROM r GROUP BY chat_id, batch HAVING bool_or(hit)"""


@query(_BATCHES)
def planned_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The micro-batches of finished chats."""
    return batches.all_batches(messages(spark, sf_dir).filter(~F.col("is_system")), 150)


@query(_BATCHES)
def streamed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches from a stream over the table's files, written once to the shared folder."""
    stream = batches.micro_batches(_stream(spark, sf_dir), 150)
    return _ran(spark, stream)


@query(_BATCHES)
def timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stateful processor with list and value states, which can also end chats that fall silent."""
    with timed.states(spark):
        return _ran(spark, timed.micro_batches(_stream(spark, sf_dir), 150))


@query(f"""WITH {MESSAGES} SELECT chat_id, idx, n_tokens, CASE WHEN n_tokens >= 20 THEN 'long' ELSE 'short' END AS kind FROM msg WHERE is_user AND NOT is_system""")
def two_phase_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream of messages whose first enrichment fails; what is left pending is caught up afterwards."""
    failed = []

    def enrich(events: DataFrame) -> DataFrame:
        if not failed:
            failed.append(True)
            raise ConnectionError("the first call fails")
        return events.withColumn("kind", F.when(F.col("n_tokens") >= 20, "long").otherwise("short"))

    folder = staging.new_path(spark, "two-phase")
    sink = extraction.TwoPhaseSink(spark, f"{folder}/out", lambda rows: rows.filter("is_user").select("chat_id", "idx", "n_tokens"), enrich)
    stream = _stream(spark, sf_dir).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    if left := sink.catch_up():
        raise RuntimeError(f"batches {left} could not be enriched")
    return sink.enriched().drop("batch")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "conversations").schema
    path = f"{sf_dir}/conversations.parquet"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else sf_dir + "/conversations*")
    log = rows.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("idx"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system"), text.token_count(F.col("text")).alias("n_tokens"))
    return log.filter(~F.col("is_system"))


def _ran(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = staging.new_path(spark, "stream")
    batches.write_once(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(batches.OUTPUT).parquet(f"{folder}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    names = read(spark, path.rpartition("/")[0], path.rpartition("/")[2].removesuffix(".parquet")).inputFiles()
    return not all(n.endswith("/conversations.parquet") for n in names)


# ---- reports and maintenance


@query(f"""WITH {MEMORIES} SELECT type, importance::BIGINT AS importance, count(*) AS n, floor(avg(importance0) * 100 + 0.5) / 100 AS mean_importance
FROM (SELECT type, importance, importance AS importance0 FROM mem) GROUP BY GROUPING SETS ((type), (importance), ())""")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.memory_stats(memories(spark, sf_dir)).withColumn("importance", F.col("importance").cast("long"))


@query(f"WITH {MEMORIES} SELECT chat_id, floor(extraction_count / 20.0)::BIGINT AS phase, min(extraction_count) AS first_message, max(extraction_count) AS last_message, count(*) AS n FROM mem GROUP BY ALL")
def timeline_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline(memories(spark, sf_dir).withColumn("message_id", F.col("extraction_count")))


@query(f"""WITH {_BALANCE} SELECT sc.chat_id, count(*) AS n, count(sel.id) AS n_selected, round(greatest(0.0, max(sc.score)), 6) AS top_score, round(min(sel.score), 6) AS cutoff,
round(avg(sc.score) FILTER (sc.id % 9 = 0), 6) AS mean_reflection, round(avg(sc.score) FILTER (sc.id % 9 <> 0), 6) AS mean_event
FROM sc LEFT JOIN sel ON sel.chat_id = sc.chat_id AND sel.id = sc.id GROUP BY sc.chat_id""")
def scoring_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each chat how many memories were scored and selected, the top score, the cutoff, and the means of both kinds."""
    rows = _bucketed(spark, sf_dir).withColumn("type", F.when(F.col("id") % 9 == 0, "reflection").otherwise("event"))
    chosen = selection.soft_balance(scoring.best(rows, 1000), 4000).select("chat_id", "id", F.lit(True).alias("s"))
    rows = rows.join(chosen, ["chat_id", "id"], "left").withColumn("selected", F.coalesce("s", F.lit(False)))
    return rounded(reports.scoring_stats(rows).drop("query_id"), "top_score", "cutoff", "mean_reflection", "mean_event")


@query(f"""WITH {MEMORIES}, p AS (SELECT chat_id, unnest(characters) AS character, type, level FROM mem), q AS (SELECT chat_id, unnest(list_distinct(characters)) AS character, importance FROM mem),
i AS (SELECT chat_id, character, sum(importance) AS s FROM q GROUP BY ALL), e AS (SELECT DISTINCT chat_id, characters[1] AS a, characters[2] AS b FROM mem WHERE characters[1] <> characters[2]),
r AS (SELECT chat_id, c, count(*) AS n FROM (SELECT chat_id, a AS c FROM e UNION ALL SELECT chat_id, b FROM e) GROUP BY ALL)
SELECT p.chat_id, p.character, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'reflection' AND level = 1) AS reflections_1,
count(*) FILTER (type = 'reflection' AND level = 2) AS reflections_2, count(*) FILTER (type = 'reflection' AND level = 3) AS reflections_3, coalesce(any_value(r.n), 0) AS relations,
round(least(1.0, any_value(s) / 40.0), 6) AS progress
FROM p JOIN i ON i.chat_id = p.chat_id AND i.character = p.character LEFT JOIN r ON r.chat_id = p.chat_id AND r.c = p.character GROUP BY p.chat_id, p.character""")
def character_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, reflections and relations of each character, and how near its next reflection is; relations are those named together, in order."""
    mem = memories(spark, sf_dir)
    first, second = (F.element_at("characters", i) for i in (1, 2))
    edges = mem.filter(first != second).groupBy("chat_id", first.alias("source"), second.alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    nodes = reports.characters(mem).select("chat_id", F.col("character").alias("key"), F.upper("character").alias("name"))
    state = reflection.accumulate(mem.withColumn("witnesses", F.lit(None).cast("array<string>")))
    return rounded(reports.dossier(mem, edges, nodes, state), "progress")


@query(f"WITH {MEMORIES} SELECT id, chat_id, importance::BIGINT AS importance FROM mem ORDER BY importance DESC, ord LIMIT 20 OFFSET 40")
def memory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of all memories by importance."""
    mem = memories(spark, sf_dir)
    return reports.page(mem, [F.desc("importance"), F.col("ord")], 2).select("id", "chat_id", F.col("importance").cast("long").alias("importance"))


@query(f"""WITH {MEMORIES}, m AS (SELECT chat_id, id, unnest([1, 2, 3]) AS p FROM mem WHERE id % 4 <> 0),
k AS (SELECT m.chat_id, m.id, p, m.id - p AS s FROM m LEFT JOIN mem g ON g.chat_id = m.chat_id AND g.id = m.id - p AND g.id % 4 = 0 WHERE g.id IS NULL)
SELECT mem.chat_id, mem.id, coalesce(string_agg(s::VARCHAR, ',' ORDER BY p), '') AS source_ids
FROM mem LEFT JOIN k ON k.chat_id = mem.chat_id AND k.id = mem.id WHERE mem.id % 4 <> 0 GROUP BY mem.chat_id, mem.id""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories after every fourth is deleted, with what their source lists still hold."""
    mem = memories(spark, sf_dir).select("chat_id", "id", F.array(F.col("id") - 1, F.col("id") - 2, F.col("id") - 3).alias("source_ids"))
    left = maintenance.delete(mem, mem.filter("id % 4 = 0").select("chat_id", "id"))
    return left.select("chat_id", "id", F.array_join(F.transform("source_ids", lambda s: s.cast("string")), ",").alias("source_ids"))


@query(f"""WITH {MEMORIES}, c AS (SELECT chat_id, max(id) // 2 AS now FROM mem GROUP BY chat_id)
SELECT mem.chat_id, id, greatest(0, least(CASE WHEN type = 'reflection' THEN now WHEN sequence > 0 THEN sequence // 1000 ELSE now END, now))::BIGINT AS extraction_count
FROM mem JOIN c ON c.chat_id = mem.chat_id""")
def migrate_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks of old memories that have none, by sequence and within the chat's clock."""
    mem = memories(spark, sf_dir)
    clock = mem.groupBy("chat_id").agg(F.floor(F.max("id") / 2).alias("count"))
    old = mem.withColumn("extraction_count", F.lit(None).cast("long")).withColumn("message_ids", F.array().cast("array<bigint>"))
    return store.backfill_clock(old, clock).select("chat_id", "id", "extraction_count")


@query(f"""WITH {MEMORIES} SELECT chat_id, id, summary FROM mem WHERE id % 3 <> 0 UNION ALL SELECT chat_id, id, 'imported' FROM mem WHERE id % 3 = 0""")
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the store with an export of everything merged in: only what is missing comes from the export."""
    mem = memories(spark, sf_dir).select("chat_id", "id", "summary")
    lines = store.export_json(mem.withColumn("summary", F.lit("imported")))
    return store.merge_import(mem.filter("id % 3 <> 0"), store.import_json(lines, "id long, summary string"))


@query()
def macro_and_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that ask for the whole picture, and those that tell a passing state."""
    log = messages(spark, sf_dir)
    return log.select("chat_id", "idx", text.macro_intent(F.col("mes")).alias("macro"), text.looks_transient(F.col("mes")).alias("transient"))


@query()
def prompt_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each chat's selected memories."""
    chosen = selection.soft_balance(scoring.best(_bucketed(spark, sf_dir), 1000), 4000)
    return context.memory_block(chosen.withColumn("position", F.col("extraction_count"))).select("chat_id", "block")


@query()
def page_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """53-bit hashes of the pages, as fingerprints use them."""
    return read(spark, sf_dir, "pages").select("page_id", codec.text_hash("html").alias("hash"))


# ---- windows over the event stream, beyond what the engine itself needs


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and kind."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, k::BIGINT AS session, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS micros FROM s GROUP BY ALL""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: runs of events at most half an hour apart."""
    order = Window.partitionBy("user_id").orderBy("ts")
    events = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(order)) > 30 * 60 * 1_000_000, F.lit(True)).cast("int")
    marked = events.withColumn("new", gap).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("micros"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_rank(spark, sf_dir)


from . import further as _further  # noqa: E402, F401  registers its queries here
