"""Relevance of memories: decay with distance, lexical and vector bonus, frequency."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text, vector
from .. import staging
from ..staging import cut
from . import near, ranking

#: Queries that are sent to every task at once, and pairs of a chat and a query that is put to it.
MAX_QUERIES, MAX_PUT = 10_000, 10_000_000


def importance(column="importance") -> Column:
    """Missing or 0 counts as 3."""
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(3))


def decay(distance: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """damping, lambda, base and floored base of a memory at a distance from now.

    lambda = base_lambda / importance^2, slowed by hits (to half at most) and multiplied for transient memories. The base of
    importance 5 never falls below 1.
    """
    imp, hits = importance(), F.coalesce(F.col("retrieval_hits"), F.lit(0))
    damping = F.greatest(F.lit(0.5), 1 / (1 + 0.1 * hits))
    fast = F.when(F.coalesce(F.col("is_transient"), F.lit(False)), max(settings.transient_multiplier or 5.0, 0.01)).otherwise(1.0)
    rate = max(settings.base_lambda or 0.001, 0.001) / (imp * imp) * damping * fast
    base = imp * F.exp(-rate * distance)
    return {"damping": damping, "lambda": rate, "base": base, "floored": F.when(imp == 5, F.greatest(base, F.lit(1.0))).otherwise(base)}


def vector_bonus(similarity: Column, settings: Settings = DEFAULTS) -> Column:
    """What a similarity strictly above the threshold adds."""
    t, a = min(max(settings.vector_threshold or 0.0, 0.0), 0.99), min(max(settings.alpha or 0.0, 0.0), 1.0)
    return F.when(similarity > t, a * max(settings.boost or 0.0, 0.0) * (similarity - t) / (1 - t)).otherwise(F.lit(0.0))


def lexical_bonus(normalized: Column, settings: Settings = DEFAULTS) -> Column:
    return (1 - min(max(settings.alpha or 0.0, 0.0), 1.0)) * max(settings.boost or 0.0, 0.0) * normalized


def frequency_factor(column="mentions") -> Column:
    return 1 + F.log(F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(1))) * 0.05


def reflection_factor(distance: Column, settings: Settings = DEFAULTS) -> Column:
    """Reflections lose weight linearly beyond a distance, to a quarter at most; each level halves the loss."""
    t = settings.reflection_decay_after
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1))
    factor = F.greatest(F.lit(0.25), 1 - (distance - t) / (2 * t * F.pow(F.lit(settings.reflection_level_multiplier), level - 1)))
    return F.when((F.col("type") == "reflection") & (distance > t), factor).otherwise(F.lit(1.0))


def score(memories: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Two passes over memories with the columns distance, bm25_norm and similarity (null without a vector).

    The first pass ranks all memories without vectors; the best ``vector_pass`` of a query and chat get the vector bonus. Where that applies, the
    reflection factor doesn't. Adds base, base_after_floor, recency_penalty (what the floor adds), hit_damping, bm25_bonus, vector_bonus, frequency, fast_score and
    score; with distance, importance, similarity and bm25_norm these tell how a score came about.
    """
    distance = F.col("distance")
    parts = decay(distance, settings)
    fast = (F.col("base_after_floor") + F.col("bm25_bonus")) * F.col("frequency")
    scored = memories.withColumns({
        "base": parts["base"],
        "base_after_floor": parts["floored"],
        "recency_penalty": parts["floored"] - parts["base"],
        "hit_damping": parts["damping"],
        "bm25_bonus": lexical_bonus(F.coalesce("bm25_norm", F.lit(0.0)), settings),
        "frequency": frequency_factor(),
        "reflection": reflection_factor(distance, settings),
    }).withColumn("fast_score", fast * F.col("reflection"))
    key = ["query_id", "chat_id"]
    best = ranking.top_n(scored.select(*key, "id", "ord", "fast_score"), key, [F.desc("fast_score"), F.col("ord")], settings.vector_pass)
    chosen = best.select(*key, "id", F.lit(True).alias("in_pass"))
    bonus = vector_bonus(F.coalesce("similarity", F.lit(0.0)), settings)
    scored = scored.join(chosen, [*key, "id"], "left").withColumn("vector_bonus", F.when(F.col("in_pass"), bonus).otherwise(F.lit(0.0)))
    full = (F.col("base_after_floor") + F.col("vector_bonus") + F.col("bm25_bonus")) * F.col("frequency")
    return scored.withColumn("score", F.when(F.col("vector_bonus") > 0, full).otherwise(F.col("fast_score"))).drop("in_pass", "reflection")


def bases(memories: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Memories (with distance) with what no query changes: base, base_after_floor, recency_penalty, hit_damping, frequency, reflection and base_score, the score without any bonus."""
    parts = decay(F.col("distance"), settings)
    told = memories.withColumns({
        "base": parts["base"],
        "base_after_floor": parts["floored"],
        "recency_penalty": parts["floored"] - parts["base"],
        "hit_damping": parts["damping"],
        "frequency": frequency_factor(),
        "reflection": reflection_factor(F.col("distance"), settings),
    })
    return told.withColumn("base_score", F.col("base_after_floor") * F.col("frequency") * F.col("reflection"))


def fast_pass(rows: DataFrame, hits: DataFrame, asked: DataFrame, n: int | None, settings: Settings = DEFAULTS) -> DataFrame:
    """The first pass: the rows of ``bases`` that a query can rank among the first ``n``, with bm25_norm, bm25_bonus and fast_score; all rows of its chats where n is None.

    ``asked`` (query_id, chat_id) says which chats a query is put to, ``hits`` (query_id, chat_id, id, bm25_norm) which memories have its words. A bonus only adds to a score.
    So a memory without one that isn't among its chat's first n by base_score has n others before it for every query, and queries meet only these and their hits.
    """
    key = ["query_id", "chat_id"]
    front = rows.select("chat_id", "id", "ord", "base_score")
    if n is not None:
        front = ranking.top_n(front, ["chat_id"], [F.desc("base_score"), F.col("ord")], max(n, settings.vector_pass))
        # few rows, of which each meets all queries of its chat: dealt out, as Spark would leave them to one task
        session = rows.sparkSession
        front = front.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), "chat_id", "id")
    met = _put(front.select("chat_id", "id"), _put_to(asked)).select(*key, "id", F.lit(None).cast("double").alias("bm25_norm"))
    own = hits.select(*key, "id", "bm25_norm")
    if n is None:
        found = met.drop("bm25_norm").join(own, [*key, "id"], "left")  # all memories are met, hits among them
    else:
        found = met.unionByName(own).groupBy(*key, "id").agg(F.max("bm25_norm").alias("bm25_norm"))
    scored = found.join(rows, ["chat_id", "id"]).withColumn("bm25_bonus", lexical_bonus(F.coalesce("bm25_norm", F.lit(0.0)), settings))
    return scored.withColumn("fast_score", (F.col("base_after_floor") + F.col("bm25_bonus")) * F.col("frequency") * F.col("reflection"))


def _put_to(asked: DataFrame) -> DataFrame:
    """chat_id, queries: the queries of each chat in arrays, written; sent to every task up to MAX_PUT of them."""
    n = asked.count()
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 + n // MAX_QUERIES)).alias("__block")
    arrays = staging.written(asked.groupBy("chat_id", block).agg(F.collect_list("query_id").alias("queries")).drop("__block"), "put-to")
    return F.broadcast(arrays) if n <= MAX_PUT else arrays


def _put(rows: DataFrame, put: DataFrame) -> DataFrame:
    """The rows with each query_id that is put to their chat."""
    return rows.join(put, "chat_id").withColumn("query_id", F.explode("queries")).drop("queries")


def in_pass(fast: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, chat_id, id, vec_id of the ``vector_pass`` best of each query and chat by fast_score."""
    key = ["query_id", "chat_id"]
    best = ranking.top_n(fast.select(*key, "id", "ord", "vec_id", "fast_score"), key, [F.desc("fast_score"), F.col("ord")], settings.vector_pass)
    return best.select(*key, "id", "vec_id")


def late_similarities(chosen: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """query_id, chat_id, id, similarity of the chosen pairs of query and memory, and of no others.

    Only the vectors (vec_id, embedding) that were chosen leave their scan; ``query_vectors`` has query_id and query_vector.
    """
    needed = staging.small(chosen.select("vec_id").distinct())
    fetched = vectors.select("vec_id", "embedding", vector.norm(F.col("embedding")).alias("norm")).join(needed, "vec_id", "left_semi")
    asked = query_vectors.select("query_id", "query_vector", vector.norm(F.col("query_vector")).alias("query_norm"))
    pairs = chosen.join(fetched, "vec_id").join(staging.small(asked), "query_id")
    usable = pairs.filter(F.col("embedding").isNotNull() & F.col("query_vector").isNotNull())
    return usable.select("query_id", "chat_id", "id", _cosine().alias("similarity"))


def _cosine() -> Column:
    """The cosine of embedding and query_vector by their norms, which are taken once for each vector and query; 0 where one is missing or the lengths differ."""
    size = F.col("norm") * F.col("query_norm")
    same = F.col("embedding").isNotNull() & F.col("query_vector").isNotNull() & (F.size("embedding") == F.size("query_vector")) & (size > 0)
    return F.when(same, vector.dot(F.col("embedding"), F.col("query_vector")) / size).otherwise(F.lit(0.0))


def score_late(memories: DataFrame, hits: DataFrame, asked: DataFrame, vectors: DataFrame, query_vectors: DataFrame, n: int | None, settings: Settings = DEFAULTS, digits: int | None = None) -> DataFrame:
    """Both passes with late vectors: memories (chat_id, id, ord, vec_id, distance and what ``score`` needs) with fast_score, similarity, vector_bonus and score.

    The scores are those of ``score``. Rows that no query can rank among its first ``n`` are left out (``fast_pass``), and cosines are made for the ``vector_pass`` best
    of a query and chat only, whatever the number of memories. What both passes read again is written once. With ``digits`` score and vector_bonus are rounded, once for
    each memory where its score is that of all queries.
    """
    key = ["query_id", "chat_id"]
    rows = staging.written(bases(memories, settings), "bases")
    fast = staging.written(fast_pass(rows, hits, asked, settings.vector_pass if n is None else n, settings), "fast")
    near = late_similarities(staging.written(in_pass(fast, settings), "in-pass"), vectors, query_vectors)
    full = (F.col("base_after_floor") + F.col("vector_bonus") + F.col("bm25_bonus")) * F.col("frequency")
    scored = fast.join(near, [*key, "id"], "left").withColumn("vector_bonus", vector_bonus(F.coalesce("similarity", F.lit(0.0)), settings))
    scored = scored.withColumn("score", F.when(F.col("vector_bonus") > 0, full).otherwise(F.col("fast_score")))
    if digits is not None:
        scored = scored.withColumns({c: F.round(c, digits) for c in ("score", "vector_bonus")})
    if n is None:
        scored = scored.unionByName(_behind(rows, hits, asked, settings, digits).select(*scored.columns))
    return scored.drop("reflection", "base_score")


def _behind(rows: DataFrame, hits: DataFrame, asked: DataFrame, settings: Settings, digits: int | None = None) -> DataFrame:
    """The pairs of query and memory that ``fast_pass`` leaves out, whose score is the same for every query: made where a memory is read, so that none of them is shuffled.

    What they have in common is made before a memory meets its queries.
    """
    front = ranking.top_n(rows.select("chat_id", "id", "ord", "base_score"), ["chat_id"], [F.desc("base_score"), F.col("ord")], settings.vector_pass)
    same, none, zero = F.col("base_score"), F.lit(None).cast("double"), F.lit(0.0)
    told = {"bm25_norm": none, "bm25_bonus": zero, "fast_score": same, "similarity": none, "vector_bonus": zero, "score": same if digits is None else F.round(same, digits)}
    rest = rows.join(staging.small(front.select("chat_id", "id")), ["chat_id", "id"], "left_anti").withColumns(told)
    hit, put = hits.select("chat_id", "id").distinct(), _put_to(asked)
    never = _put(rest.join(hit, ["chat_id", "id"], "left_anti"), put)
    others = _put(rest.join(hit, ["chat_id", "id"], "left_semi"), put).join(hits.select("query_id", "chat_id", "id"), ["query_id", "chat_id", "id"], "left_anti")
    return never.unionByName(others.select(*never.columns))


def best(scored: DataFrame, n: int) -> DataFrame:
    return ranking.top_n(scored, ["query_id", "chat_id"], [F.desc("score"), F.col("ord")], n)


def half_life(distance: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """half_life and remaining life (three half-lives less the distance, 0 at least) of a memory's base."""
    life = F.lit(0.6931471805599453) / decay(distance, settings)["lambda"]
    return {"half_life": life, "remaining": F.greatest(F.lit(0.0), 3 * life - distance)}


def fading_label(transient: Column, half_life: Column, remaining: Column) -> Column:
    """How long a transient memory lasts, in words: by what remains where that is known, else by its half-life; empty for others."""

    def about(x: Column, to: int) -> Column:
        return (text.half_up(x / to) * to).cast("long").cast("string")

    def steps(x: Column) -> Column:
        return F.when(x < 20, about(x, 1)).when(x < 100, about(x, 5)).otherwise(about(x, 10))

    left = F.when(remaining < 0.5, "Faded").otherwise(F.concat(F.lit("Fades in ~"), steps(remaining), F.when(steps(remaining) == "1", " extraction").otherwise(" extractions")))
    alone = F.when(half_life < 1, "Fades: <1 extraction").otherwise(F.concat(F.lit("Fades: ~"), steps(half_life), F.lit(" extractions")))
    return F.when(F.coalesce(transient, F.lit(False)), F.when(remaining.isNotNull(), left).otherwise(alone)).otherwise("")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, at_least: float = 0.0) -> DataFrame:
    """query_id, id, similarity, place, proxy: the k vectors most like each query (query_id, query_vector), compared to nine places, ties by id.

    Vectors and queries meet by blocks (``near.best``). With ``at_least`` of 0 or less, what is like nothing counts too, with a similarity of 0, and all pairs are made.
    """
    if at_least <= 0:
        return _in_blocks(queries, lambda block: _nearest(vectors, block, k, at_least))
    asked, one = queries.select(F.col("query_id").alias("l"), F.col("query_vector").alias("va")), F.lit(0).alias("all")
    found = near.best(asked.select(one, "l", "va"), vectors.select(one, F.col("id").alias("r"), F.col("embedding").alias("vb")), ["all"], at_least - 1e-9, k)
    return _with_proxy(_placed(found, vectors, queries, k, at_least))


def _placed(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, at_least: float) -> DataFrame:
    """query_id, id, similarity, place of the k best of the pairs ``found`` (l, r), by the cosines of their whole vectors."""
    found = staging.written(found.toDF("query_id", "id"), "near-best")
    pairs = found.join(vectors.select("id", "embedding", vector.norm(F.col("embedding")).alias("norm")), "id")
    pairs = pairs.join(queries.select("query_id", "query_vector", vector.norm(F.col("query_vector")).alias("query_norm")), "query_id")
    pairs = pairs.select("query_id", "id", (vector.dot(F.col("embedding"), F.col("query_vector")) / (F.col("norm") * F.col("query_norm"))).alias("similarity"))
    return _first(pairs, k, at_least)


def _first(pairs: DataFrame, k: int, at_least: float) -> DataFrame:
    about = F.round("similarity", 9)
    return ranking.top_n(pairs.filter(about >= at_least), ["query_id"], [F.desc(about), F.col("id")], k, "place")


def _with_proxy(found: DataFrame) -> DataFrame:
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(counts, "query_id").withColumn("proxy", vector.rank_proxy(F.col("place"), F.col("n"))).drop("n")


def similarities(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, similarity of every vector to each query (query_id, query_vector)."""
    return _in_blocks(queries, lambda block: _cosines(vectors, block))


def _in_blocks(queries: DataFrame, run) -> DataFrame:
    """What ``run`` makes of the queries, which it sends to every task.

    More than MAX_QUERIES are dealt by a hash of query_id into blocks of half as many on average, and each block in turn is run and written.
    """
    n = queries.count()
    if n <= MAX_QUERIES:
        return run(queries)
    blocks = -(-2 * n // MAX_QUERIES)
    numbered = cut(queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    found = None
    for i in range(blocks):
        block = cut(run(numbered.filter(F.col("__block") == i).drop("__block")))
        found = block if found is None else found.unionByName(block)
    return found


def _cosines(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The cosine of all vectors and queries; 0 where one is missing or the lengths differ. Norms are taken once for each vector and query."""
    asked = F.broadcast(queries.select("query_id", "query_vector", vector.norm(F.col("query_vector")).alias("query_norm")))
    pairs = vectors.select("id", "embedding", vector.norm(F.col("embedding")).alias("norm")).join(asked, F.lit(True))
    return pairs.select("query_id", "id", _cosine().alias("similarity"))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, at_least: float) -> DataFrame:
    return _with_proxy(_first(_cosines(vectors, queries), k, at_least))


def index_lists(vectors: DataFrame, lists: int, sample: int = 50_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(centroids (list, centroid), members (list, id, embedding)) of vectors (id, embedding) by inverted lists, both written.

    The centroids are fitted by cosine k-means on at most about ``sample`` vectors, those with the smallest hash of their id; every vector is then put into the list of its
    nearest centroid. Missing and zero vectors are like nothing and in no list.
    """
    usable = vectors.filter(F.col("embedding").isNotNull() & (vector.norm(F.col("embedding")) > 0)).select("id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = usable.count()
    fitted = usable if n <= sample else usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(sample / n * (1 << 20))))
    model = KMeans(k=max(2, lists), distanceMeasure="cosine", seed=seed, maxIter=10).fit(fitted.coalesce(fitted.sparkSession.sparkContext.defaultParallelism))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(centres, "list int, centroid array<double>")
    members = model.setPredictionCol("list").transform(usable).select("list", "id", "embedding")
    return staging.written(centroids.coalesce(1), "centroids"), staging.written(members, "lists")


def nearest_in_lists(centroids: DataFrame, members: DataFrame, queries: DataFrame, k: int, probes: int, at_least: float = 0.0) -> DataFrame:
    """query_id, id, similarity, place: the k vectors most like each query among the lists of its ``probes`` nearest centroids.

    What lies in no probed list is missed, so recall is to be measured against ``nearest``; what is found bears its exact similarity.
    """
    asked = similarities(centroids.select(F.col("list").alias("id"), F.col("centroid").alias("embedding")), queries)
    probed = ranking.top_n(asked, ["query_id"], [F.desc("similarity"), F.col("id")], probes).select("query_id", F.col("id").alias("list"))
    probed = probed.join(queries.select("query_id", "query_vector"), "query_id").select("list", F.col("query_id").alias("l"), F.col("query_vector").alias("va"))
    found = near.best(probed, members.select("list", F.col("id").alias("r"), F.col("embedding").alias("vb")), ["list"], at_least - 1e-9, k)
    return _placed(found, members, queries, k, at_least)


def position(message_ids: Column, sequence: Column) -> Column:
    """Rounded mean of the message ids, else the sequence in thousands, else 0."""
    mean = F.aggregate(message_ids, F.lit(0.0), lambda s, x: s + x) / F.size(message_ids)
    return F.when(F.size(message_ids) > 0, text.half_up(mean)).otherwise(F.floor(F.coalesce(sequence, F.lit(0)) / 1000)).cast("long")
