"""Retrieval as a whole: the scene of a chat, who is asked, the query's terms, reordering, and the final selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .. import staging
from ..functions import text, vector
from . import contradiction, lexical, maintenance, ranking, scoring, selection

KEY = ["query_id", "chat_id"]


def scene(messages: DataFrame, total_tokens: int = 10_000, lines: int = 10, settings: Settings = DEFAULTS) -> DataFrame:
    """chat_id, chat_length, recent, said and the budgets scene, entity, world: what a chat's retrieval starts from.

    ``recent`` are the newest messages, newest first, ``said`` the user's last three messages as one text of 1,000 characters at most. Only as many
    messages of a chat as that takes are gathered.
    """
    shown = messages.filter(~F.col("is_system"))
    newest = ranking.top_n(shown.select("chat_id", "idx", "mes"), ["chat_id"], [F.desc("idx")], lines)
    recent = newest.groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "mes"))), lambda x: x["mes"]).alias("recent"))
    own = ranking.top_n(shown.filter("is_user").select("chat_id", "idx", "mes"), ["chat_id"], [F.desc("idx")], 3)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("mes", F.lit("")).alias("mes")))), lambda x: x["mes"]), "\n")
    said = own.groupBy("chat_id").agg(F.right(joined, F.lit(1000)).alias("said"))
    length = messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("chat_length"))
    rows = length.join(recent, "chat_id", "left").join(said, "chat_id", "left")
    split = selection.split_budget(F.lit(total_tokens), settings)
    return rows.select("chat_id", "chat_length", "recent", F.coalesce("said", F.lit("")).alias("said"), *[split[n].alias(n) for n in ("scene", "entity", "world")])


def or_all(allowed: DataFrame, hidden: DataFrame) -> DataFrame:
    """What a chat's viewers may see; in chats where that is nothing, all hidden memories."""
    some = allowed.select("chat_id").distinct()
    return allowed.unionByName(hidden.join(some, "chat_id", "left_anti"), allowMissingColumns=True)


def viewpoint(chats: DataFrame, present: DataFrame) -> DataFrame:
    """chat_id, name: who looks on. In a group (group_id) it is the character that answers (main), else those present in the last messages; if nobody is, main and user."""
    group = chats.filter(F.col("group_id").isNotNull()).select("chat_id", F.col("main").alias("name"))
    solo = chats.filter(F.col("group_id").isNull())
    seen = present.join(solo.select("chat_id"), "chat_id", "left_semi").select("chat_id", "name")
    other = solo.join(seen.select("chat_id").distinct(), "chat_id", "left_anti").select("chat_id", F.explode(F.array("main", "user")).alias("name")).filter(F.col("name").isNotNull())
    return group.unionByName(seen).unionByName(other).distinct()


def query_terms(queries: DataFrame, entities: DataFrame, vocabulary: DataFrame | None, settings: Settings = DEFAULTS, stem=None) -> DataFrame:
    """query_id, term, count, tier of queries (query_id, text) and the entities (query_id, name, weight) seen in them.

    phrase: names of several words, as they are and once. entity: words of other names, twice the rounded-up boosted weight. grounded and free: the query's
    words that the corpus has or lacks, each by its share of the boost. Without a vocabulary words count as often as said; an empty one drops them.
    """
    phrases = entities.filter(F.contains(F.trim("name"), F.lit(" "))).groupBy("query_id", F.col("name").alias("term")).agg(F.count(F.lit(1)).alias("count"))
    named = lexical.entity_terms(entities, settings, stem).select("query_id", "term", "count")
    said = lexical.query_terms(queries, stem)
    tiers = lexical.tiered_terms(said, vocabulary, settings)
    if vocabulary is None:
        worded = tiers.withColumn("tier", F.lit("said"))
    else:
        grounded = F.ceil(F.lit(settings.entity_boost * settings.grounded_ratio))
        worded = tiers.withColumn("tier", F.when(F.col("count") == grounded, "grounded").otherwise("free"))
    return phrases.withColumn("tier", F.lit("phrase")).unionByName(named.withColumn("tier", F.lit("entity"))).unionByName(worded.select("query_id", "term", "count", "tier"))


def without_names(terms: DataFrame, names: DataFrame, stem=None) -> DataFrame:
    """Terms that aren't a present character's (query_id, name): neither the whole name in lower case nor one of its words."""
    words = names.select("query_id", F.explode(F.array_union(F.array(F.lower("name")), text.tokens(F.col("name"), stem))).alias("term")).distinct()
    return terms.join(words, ["query_id", "term"], "left_anti")


def embedding_query(messages: Column, entities: Column, active: Column, chunk: int = 1800, window: int = 5) -> Column:
    """The text whose vector stands for a query: up to five entities that aren't present characters, then the newest messages as far as ``chunk`` characters reach."""
    present = F.transform(active, lambda a: F.lower(a))
    names = F.array_join(F.slice(F.filter(entities, lambda e: ~F.array_contains(present, F.lower(e))), 1, 5), " ")
    prefix = F.when(F.length(names) > 0, F.concat(names, F.lit(" "))).otherwise("")
    told = F.array_join(F.filter(F.slice(messages, 1, window), lambda m: F.length(m) > 0), " ")
    whole = F.trim(F.concat(prefix, F.left(told, F.greatest(F.lit(0), chunk - F.length(prefix)))))
    return F.when(F.size(messages) > 0, whole).otherwise("")


def from_hits(hits: DataFrame, memories: DataFrame, communities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, communities found) of an outside index's hits (query_id, chat_id, id, place from 1).

    Hits that are memories take the proxy score of their place among all hits as ``similarity``. For a query none of whose hits is a
    memory all memories of its chat are candidates, without a similarity. ``memories`` and ``communities`` have chat_id and id.
    """
    counts = hits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n"))
    placed = hits.join(counts, KEY).withColumn("similarity", vector.rank_proxy(F.col("place"), F.col("__n"))).drop("__n", "place")
    found = placed.join(memories, ["chat_id", "id"])
    lost = placed.join(memories.select("chat_id", "id"), ["chat_id", "id"], "left_anti").join(communities.select("chat_id", "id"), ["chat_id", "id"], "left_semi")
    empty = hits.select(*KEY).distinct().join(found.select(*KEY).distinct(), KEY, "left_anti")
    rest = empty.join(memories, "chat_id").withColumn("similarity", F.lit(None).cast("double"))
    return found.unionByName(rest), lost.select(*KEY, "id")


def rerank(scored: DataFrame, ranked: DataFrame, window: int = 50) -> DataFrame:
    """Scored rows (rank from 1) with ``place``: those that a reranker ranked (query_id, chat_id, index from 0, score) first, in its order, then all others in theirs.

    Only the first ``window`` rows were sent. Of an index that comes twice the better score counts, and ties go to the lower index; without an answer nothing changes.
    """
    best = ranked.groupBy(*KEY, "index").agg(F.max("score").alias("reranker_score"))
    rows = scored.withColumn("index", F.when(F.col("rank") <= window, F.col("rank") - 1)).join(best, [*KEY, "index"], "left").drop("index")
    order = [F.col("reranker_score").isNull(), F.desc("reranker_score"), F.col("rank")]
    return ranking.top_n(rows, KEY, order, DEFAULTS.scored_rows, "place")


def select(scored: DataFrame, budget: int, ranked=None, settings: Settings = DEFAULTS, texts: DataFrame | None = None) -> DataFrame:
    """The memories that a query is given: the best rows, reordered, balanced over ages under the budget, at most two of importance 5, none that a newer one contradicts.

    ``scored`` has query_id, chat_id, id, ord, score, importance, bucket, n_tokens and extraction_count; characters and summary are its own or those of ``texts`` (chat_id, id),
    which are read for chosen rows only. ``ranked`` is a reranker's answer, or makes one of the best rows. The cap keeps those of the best own score, also after a reranker. The best rows and
    the choice are written, as each is used several times.
    """
    wide = [c for c in ("characters", "summary") if c in scored.columns]
    if texts is None:
        texts = scored.select(*KEY, "id", *wide)
    top = staging.written(ranking.top_n(scored.drop(*wide), KEY, [F.desc("score"), F.col("ord")], settings.scored_rows), "top")
    if callable(ranked):
        ranked = ranked(top)
    if ranked is None:
        chosen = selection.soft_balance(top, budget)
    else:
        placed = staging.written(rerank(top, ranked).withColumn("own", F.col("score")).withColumn("score", -F.col("place").cast("double")), "placed")
        chosen = selection.soft_balance(placed, budget).withColumn("score", F.col("own")).drop("own", "place", "reranker_score")
    capped = staging.written(selection.cap_importance(staging.written(chosen, "chosen"), top, budget, settings.top_importance_cap), "capped")
    # written before anybody asks for their mood, which would else be told of every memory in its scan
    given = staging.written(staging.small(capped).join(texts, [c for c in (*KEY, "id") if c in texts.columns]), "given")
    return _without_contradicted(given)


def _without_contradicted(chosen: DataFrame) -> DataFrame:
    """Within each query's selection: chat and query are one scope for the filter."""
    scoped = chosen.withColumn("__chat", F.col("chat_id")).withColumn("chat_id", F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("chat_id").cast("string")))
    return contradiction.without_contradicted(scoped).withColumn("chat_id", F.col("__chat")).drop("__chat")


def count_hits(memories: DataFrame, selected: DataFrame) -> DataFrame:
    """Memories with one hit more for each query that was given them."""
    more = selected.groupBy("chat_id", "id").agg(F.count(F.lit(1)).alias("__h"))
    return memories.join(more, maintenance.ID, "left").withColumn("retrieval_hits", F.coalesce("retrieval_hits", F.lit(0)) + F.coalesce("__h", F.lit(0))).drop("__h")


def details(scored: DataFrame, selected: DataFrame) -> DataFrame:
    """All scored rows with ``selected``: what a report on a retrieval is made from."""
    mark = selected.select(*KEY, "id", F.lit(True).alias("selected"))
    return scored.join(mark, [*KEY, "id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def rejected(detail: DataFrame, n: int = 15) -> DataFrame:
    """The best rows of each query that weren't selected."""
    return ranking.top_n(detail.filter(~F.col("selected")), KEY, [F.desc("score"), F.col("ord")], n)


def compact(detail: DataFrame, summary_limit: int = 120) -> DataFrame:
    """query_id, chat_id, id, scores: a row's scores as JSON, rounded to two places, without those that have their usual value; the summary is cut."""
    usual = {"score": None, "base_after_floor": None, "bm25_bonus": 0.0, "vector_bonus": 0.0, "frequency": 1.0, "importance": 3, "retrieval_hits": 0, "mentions": 1, "is_transient": False}
    parts = []
    for name, default in usual.items():
        if name in detail.columns:
            value = F.col(name)
            if detail.schema[name].dataType.typeName() == "double":
                value = text.two_places(value)
            parts.append((value if default is None else F.when(value != F.lit(default), value)).alias(name))
    if "summary" in detail.columns:
        parts.append(F.left("summary", F.lit(summary_limit)).alias("summary"))
    return detail.select(*KEY, "id", F.to_json(F.struct(*parts)).alias("scores"))


def recall(memories: DataFrame, queries: DataFrame, entities: DataFrame, vectors: DataFrame, budget: int, ranked=None, settings: Settings = DEFAULTS, stem=None) -> DataFrame:
    """From queries to the memories they are given, with all scores, in one call.

    ``memories`` (chat_id, id, ord, vec_id, distance, extraction_count, bucket, n_tokens, characters, summary and what scoring needs) are those a query may be given;
    ``archived`` ones count for the corpus only. ``queries`` has query_id, chat_id, text and query_vector (null: no vectors), ``entities`` (query_id, name, weight) what is named in
    them, ``vectors`` vec_id and embedding. Words count by tier, names of several words are looked up as phrases, both bonuses are put on one scale, vectors are fetched for the
    first pass's best only, and ``ranked`` reorders (``select``).
    """
    told = staging.written(lexical.tokenized(memories, stem), "tokens")
    placed = lexical.positions(memories)
    asked, said = queries.select(*KEY).distinct(), queries.select("query_id", "text").distinct()
    corpus = staging.small(staging.written(lexical.corpus_size(told), "corpus"))
    named = lexical.entity_terms(entities, settings, stem).select("query_id", "term")
    posted = staging.written(lexical.postings(told, lexical.query_terms(said, stem).select("query_id", "term").unionByName(named)), "postings")
    terms = staging.written(query_terms(said, entities, posted, settings, stem), "query-terms")
    words = terms.filter("tier != 'phrase'").groupBy("query_id", "term").agg(F.sum("count").alias("count"))
    own = lexical.bm25(lexical.weigh_terms(words, lexical.idf_table(posted, corpus), corpus), posted, corpus, settings)
    phrases = terms.filter("tier = 'phrase'").select("query_id", F.col("term").alias("phrase"))
    bonus = lexical.phrase_matches(phrases, placed).join(phrases, "phrase").join(lexical.greatest_idf(told, corpus), "chat_id")
    bonus = bonus.select(*KEY, "id", (settings.phrase_boost * F.col("max_idf")).alias("bm25"))
    active = memories.filter(~F.coalesce("archived", F.lit(False))).drop("characters", "summary", "archived")
    hits = own.unionByName(bonus).groupBy(*KEY, "id").agg(F.sum("bm25").alias("bm25")).join(asked, KEY, "left_semi")
    hits = staging.written(hits.join(active.select("chat_id", "id"), ["chat_id", "id"], "left_semi").select(*KEY, "id", "bm25"), "hits")
    scored = score_asked(active, lexical.normalized(hits), queries, vectors, settings)
    return select(scored, budget, ranked, settings, memories.select("chat_id", "id", "characters", "summary"))


def score_asked(active: DataFrame, hits: DataFrame, queries: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    asked = queries.select("query_id", "query_vector").dropDuplicates(["query_id"])
    return scoring.score_late(active, hits, queries.select(*KEY).distinct(), vectors, asked, settings.scored_rows, settings).withColumn("score", F.round("score", 9))
