"""Late vectors, phrases by place, block maxima, kept statistics and retrieval as a whole, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from recallspark import staging
from recallspark.config import Settings
from recallspark.functions import text
from recallspark.operators import blockmax, lexical, ranking, retrieval, scoring, statistics
from recallspark.plans import registry
from recallspark.plans import further

SF = "/root/testdata/sf0.001"
KEY = ["query_id", "chat_id"]


@pytest.fixture(scope="module")
def scene(spark):
    """300 memories of two chats with vectors of three numbers, three queries, and words of some."""
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", i, i, i % 40, rng.randint(0, 900), rng.randint(1, 5), rng.random() < 0.2, rng.randint(0, 4), rng.randint(1, 4), rng.choice(["event", "reflection"]), 1 + i % 3) for i in range(300)]
    mem = spark.createDataFrame(rows, "chat_id string, id long, ord long, vec_id long, distance long, importance int, is_transient boolean, retrieval_hits int, mentions int, type string, level int")
    vectors = spark.createDataFrame([(i, None if i == 7 else [0.0] * 3 if i == 8 else [rng.random() - 0.3 for _ in range(3)]) for i in range(39)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, [rng.random() for _ in range(3)]) for q in range(3)], "query_id long, query_vector array<double>")
    hits = spark.createDataFrame([(q, "a" if i % 3 else "b", i, rng.random()) for q in range(3) for i in range(0, 300, 4 + q)], "query_id long, chat_id string, id long, bm25_norm double")
    return mem, vectors, queries, hits


@pytest.mark.parametrize("n", [5, 25, None])
def test_late_scores_are_those_of_all_vectors(spark, scene, n):
    mem, vectors, queries, hits = scene
    settings = Settings(vector_pass=20, vector_threshold=0.1)
    asked = queries.select("query_id").join(mem.select("chat_id").distinct(), F.lit(True))
    rows = mem.join(queries, F.lit(True)).join(vectors, "vec_id", "left").join(hits, [*KEY, "id"], "left")
    from recallspark.functions import vector

    similarity = F.when(F.col("embedding").isNotNull(), vector.cosine(F.col("embedding"), F.col("query_vector")))
    whole = scoring.score(rows.withColumn("similarity", similarity), settings)
    late = scoring.score_late(mem, hits, asked, vectors, queries, n, settings)

    def told(df):
        best = df if n is None else ranking.top_n(df, KEY, [F.desc("score"), F.col("ord")], n)
        return sorted((r.query_id, r.chat_id, r.id, round(r.score, 9), round(r.vector_bonus, 9)) for r in best.collect())

    assert told(late) == told(whole)


def test_all_scores_put_the_front_to_queries_only(spark, scene, monkeypatch):
    """Where all memories are scored, only those that a pass can hold and those with hits are written and joined for each query."""
    mem, vectors, queries, hits = scene
    asked, sizes = queries.select("query_id").join(mem.select("chat_id").distinct(), F.lit(True)), {}
    written = scoring.staging.written

    def counted(df, name, *rest):
        table = written(df, name, *rest)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(scoring.staging, "written", counted)
    late = scoring.score_late(mem, hits.limit(0), asked, vectors, queries, None, Settings(vector_pass=20))
    assert late.count() == 900 and sizes["fast"] == 20 * 2 * 3


@pytest.mark.parametrize("most", [0, 10_000])
def test_queries_are_put_to_memories_as_arrays(spark, scene, monkeypatch, most):
    """F1: a memory meets the queries of its chat as an array, with its own score rounded before; no row of a query and chat is joined, and the front is dealt to all tasks."""
    mem, vectors, queries, hits = scene
    asked = queries.select("query_id").join(mem.select("chat_id").distinct(), F.lit(True))
    asked = asked.unionByName(asked.filter("query_id = 1 and chat_id = 'b'").selectExpr("query_id + 100 as query_id", "chat_id")).filter("query_id != 2 or chat_id != 'a'")
    settings, written, arrays = Settings(vector_pass=20, vector_threshold=0.1), staging.written, []
    plain = {(r.query_id, r.chat_id, r.id): (r.score, r.vector_bonus) for r in scoring.score_late(mem, hits, asked, vectors, queries, None, settings).collect()}
    assert len(plain) == 200 * 2 + 100 * 4  # chat a is put two queries and chat b four, of which one has no vector
    monkeypatch.setattr(scoring.staging, "written", lambda df, name, *rest: (arrays.append((name, table := written(df, name, *rest))), table)[1])
    monkeypatch.setattr(scoring, "MAX_PUT", most)
    late = scoring.score_late(mem, hits, asked, vectors, queries, None, settings, 3)
    got = {(r.query_id, r.chat_id, r.id): (r.score, r.vector_bonus) for r in late.collect()}
    assert got.keys() == plain.keys() and all(abs(x - y) <= 0.0005000001 for k in got for x, y in zip(got[k], plain[k]))
    assert all(round(x, 3) == x for pair in got.values() for x in pair)
    put = [table for name, table in arrays if name == "put-to"]
    assert [sorted((r.chat_id, sorted(r.queries)) for r in t.collect()) for t in put] == [[("a", [0, 1]), ("b", [0, 1, 2, 101])]] * 2
    plan = scoring.fast_pass(scoring.bases(mem, settings), hits, asked, 20, settings)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Generate explode(queries" in plan


def test_cosines_are_made_for_the_pass_only(spark, scene):
    """However many memories there are, cosines <= vector_pass x chats x queries, and vectors that no query chose don't leave their scan."""
    mem, vectors, queries, hits = scene
    settings = Settings(vector_pass=10)
    asked = queries.select("query_id").join(mem.select("chat_id").distinct(), F.lit(True))
    counts = []
    for times in (1, 4):
        more = mem.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumns({"id": F.col("id") + 1000 * F.col("__k"), "ord": F.col("ord") + 1000 * F.col("__k")}).drop("__k")
        fast = scoring.fast_pass(scoring.bases(more, settings), hits, asked, 10, settings)
        chosen = scoring.in_pass(fast, settings)
        counts.append((scoring.late_similarities(chosen, vectors, queries).count(), chosen.count(), fast.count()))
    assert all(c <= p == 10 * 2 * 3 for c, p, _ in counts)
    assert counts[1][2] < 3 * 1200  # queries meet the front of each chat and their hits, not all memories


def test_first_pass_meets_few_memories_of_a_large_chat(spark):
    mem = spark.range(5000).select(F.lit("a").alias("chat_id"), "id", F.col("id").alias("ord"), F.col("id").alias("distance"), F.lit(3).alias("importance"), F.lit(False).alias("is_transient"), F.lit(0).alias("retrieval_hits"), F.lit(1).alias("mentions"), F.lit("event").alias("type"), F.lit(1).alias("level"), F.lit(0).alias("vec_id"))
    hits = spark.createDataFrame([(1, "a", 4999, 1.0)], "query_id long, chat_id string, id long, bm25_norm double")
    found = scoring.fast_pass(scoring.bases(mem), hits, spark.createDataFrame([(1, "a")], "query_id long, chat_id string"), 20)
    assert found.count() == 201


PHRASES = ["red door", "ed do", "the  RED door", "door - way", "x -", "- -", "word", "door.", "a b", "don't go", "go home now please", "é à", "the red", "red\tdoor", " red door ", "b c"]
TEXTS = ["The red door, a way.", "red  door", "red\n door way", "shred doorstep", "reddoor", "door - way", "door -- way", "doorway", "x", "box y", None, "", "a b", "a - b", "dont go home", "Please don't go home now, please", "é à É À", "the red red door", "...the red", "cab bcd"]


def test_phrases_by_place_are_those_found_in_texts(spark):
    mem = spark.createDataFrame([("c", i, t) for i, t in enumerate(TEXTS)], "chat_id string, id long, summary string")
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    expected = mem.join(phrases, F.lit(True)).filter(text.has_phrase(F.col("summary"), F.col("phrase"))).select("phrase", "chat_id", "id")
    found = lexical.phrase_matches(phrases, lexical.positions(mem)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected.collect())) and len(found) > 20
    assert lexical.phrase_matches(phrases.limit(0), lexical.positions(mem)).count() == 0
    assert lexical.phrase_matches(phrases, lexical.positions(mem.limit(0))).count() == 0


def test_phrases_shuffle_what_is_found_only(spark):
    """Words meet the phrases where they are read: a memory is one row of places, and only matches are dealt, to be made distinct."""
    mem = spark.createDataFrame([("c", i, t) for i, t in enumerate(TEXTS)], "chat_id string, id long, summary string")
    placed = lexical.positions(mem)
    assert placed.count() == len(TEXTS)
    found = lexical.phrase_matches(spark.createDataFrame([("the red door",), ("door way",), ("zzz door",)], "phrase string"), placed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sorted(map(tuple, found.collect())) == [("door way", "c", 2), ("the red door", "c", 0)]


def test_phrases_write_and_send_nothing_that_grows_with_the_texts(spark, monkeypatch):
    """of texts with ever more words that a phrase's part may end or begin, only the phrases are written and sent to tasks, in blocks where there are many."""
    written = staging.written
    kept = []
    monkeypatch.setattr(staging, "written", lambda df, name, by=None: kept.append((name, written(df, name, by))) or kept[-1][1])
    mem = spark.createDataFrame([("c", i, t) for i, t in enumerate(TEXTS)] + [("c", 100 + i, f"w{i}red doo{i}r v{i}ed dor") for i in range(300)], "chat_id string, id long, summary string")
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    expected = sorted(map(tuple, mem.join(phrases, F.lit(True)).filter(text.has_phrase(F.col("summary"), F.col("phrase"))).select("phrase", "chat_id", "id").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lexical.phrase_matches(phrases, lexical.positions(mem))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == expected and len(expected) > 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sum(df.count() for _, df in kept) <= len(PHRASES)
    monkeypatch.setattr(lexical, "MAX_PHRASES", 5)
    assert sorted(map(tuple, lexical.phrase_matches(phrases, lexical.positions(mem)).collect())) == expected


@pytest.mark.parametrize("words", [4, 100])
def test_block_maxima_read_less_and_find_the_same(spark, words):
    sf = "/root/testdata/sf0.01"
    told = staging.written(lexical.tokenized(registry.memories(spark, sf)), "tokens")
    blocks = blockmax.index(told, 16)
    items = registry._items(spark, sf).withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, words), " "))
    terms = staging.written(lexical.query_terms(items), "terms")
    best, read = blockmax.top(terms, blocks, 3)
    posted = lexical.postings(told, terms)
    idf = lexical.idf_table(posted, blocks.corpus)
    scores = lexical.bm25(lexical.weigh_terms(terms, idf, blocks.corpus), posted, blocks.corpus).withColumn("bm25", F.round("bm25", 9))
    plain = ranking.top_n(scores, KEY, [F.desc("bm25"), F.col("id")], 3)
    assert sorted(map(tuple, best.select(*KEY, "id", "bm25", "rank").collect())) == sorted(map(tuple, plain.select(*KEY, "id", "bm25", "rank").collect()))
    assert (read.agg(F.sum("n")).first()[0] or 0) <= blockmax.frequent_postings(blocks, terms, 3)


def test_block_maxima_on_a_large_chat(spark):
    """A chat of 20,000 memories, three frequent words and rare ones: under a third of the frequent words' postings are read."""
    rng = random.Random(5)
    rows = [("a", i, " ".join(["common"] * rng.randint(0, 2) + ["usual"] * rng.randint(0, 2) + ["often"] * rng.randint(0, 1) + [f"word{rng.randint(0, 3000)}", f"word{rng.randint(0, 60)}"])) for i in range(20_000)]
    told = staging.written(lexical.tokenized(spark.createDataFrame(rows, "chat_id string, id long, summary string").repartition(8)), "tokens")
    blocks = blockmax.index(told, 8)
    terms = spark.createDataFrame([(q, t, 1) for q in range(10) for t in ("common", "usual", "often", f"word{q * 7}", f"word{q * 211 % 3000}")], "query_id long, term string, count long").distinct()
    best, read = blockmax.top(terms, blocks, 10)
    posted = lexical.postings(told, terms)
    scores = lexical.bm25(lexical.weigh_terms(terms, blocks.idf, blocks.corpus), posted, blocks.corpus).withColumn("bm25", F.round("bm25", 9))
    plain = ranking.top_n(scores, KEY, [F.desc("bm25"), F.col("id")], 10)
    assert sorted(map(tuple, best.select(*KEY, "id", "bm25").collect())) == sorted(map(tuple, plain.select(*KEY, "id", "bm25").collect()))
    assert read.agg(F.sum("n")).first()[0] < blockmax.frequent_postings(blocks, terms, 10) / 3


def test_kept_statistics_equal_a_rebuild(spark, tmp_path):
    rows = [("a", 1, "red house red"), ("a", 2, "house garden"), ("b", 3, "garden tree"), ("b", 4, None), ("c", 5, "the a")]
    mem = spark.createDataFrame(rows, "chat_id string, id long, summary string")
    kept = statistics.Statistics(spark, str(tmp_path / "s"))
    assert kept.idf().count() == 0 and kept.corpus().count() == 0
    kept.apply(1, added=mem)
    kept.apply(2, added=spark.createDataFrame([("a", 2, "house river")], mem.schema), removed=mem.filter("id = 2"))
    for _ in range(2):  # a batch that is repeated counts once
        kept.apply(3, removed=mem.filter("id in (3, 5)"))
    now = spark.createDataFrame([("a", 1, "red house red"), ("a", 2, "house river"), ("b", 4, None)], mem.schema)

    def told(df):
        return sorted((r[0], r[1], *(round(x, 9) for x in r[2:])) for r in df.collect())

    for s in (kept, kept.compact(str(tmp_path / "t"))):
        assert told(s.idf()) == told(lexical.idf_table(lexical.postings(now), lexical.corpus_size(now)))
        assert told(s.corpus()) == told(lexical.corpus_size(now))
        assert {tuple(r) for r in s.vocabulary().collect()} == {("a", "red"), ("a", "house"), ("a", "river")}


def test_each_phase_and_a_contradiction_occur(spark):
    found = further.recalled(spark, "/root/testdata/sf0.01").toPandas()
    assert set(found.phase) == {1, 2, 3} and found.phase.value_counts().min() >= 5


def test_recall_of_nothing(spark):
    mem = further._moody(spark, SF).withColumns({"distance": F.lit(0), "vec_id": F.lit(0), "bucket": F.lit("old"), "n_tokens": F.lit(5)})
    queries = spark.createDataFrame([], "query_id long, chat_id string, text string, query_vector array<double>")
    entities = spark.createDataFrame([], "query_id long, name string, weight double")
    vectors = spark.createDataFrame([], "vec_id int, embedding array<double>")
    assert retrieval.recall(mem, queries, entities, vectors, 100).count() == 0


def test_pivots_lose_no_pair_and_leave_most_out(spark):
    import numpy as np
    from recallspark.functions import vector
    from recallspark.operators import graph

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 12))
    rows = [("a" if i % 4 else "b", "PERSON", f"k{i}", [float(x) for x in centres[i % 25] + 0.2 * rng.normal(size=12)]) for i in range(1500)]
    rows += [("a", "PERSON", "none", None), ("a", "PERSON", "zero", [0.0] * 12), ("a", "PERSON", "short", [1.0, 2.0])]
    nodes = spark.createDataFrame(rows, "chat_id string, type string, key string, vb array<double>")
    new = spark.createDataFrame([(c, t, "n" + k, v) for c, t, k, v in rows[::17] + rows[-3:]], "chat_id string, type string, name string, va array<double>")
    pairs = new.join(nodes, ["chat_id", "type"])
    expected = {(r.name, r.key) for r in pairs.filter(vector.cosine(F.col("va"), F.col("vb")) >= 0.8).collect()}
    found = {(r.name, r.key) for r in graph.near_pairs(new, nodes, 0.8).collect()}
    assert expected <= found and len(found) < 0.35 * pairs.count()


@pytest.mark.parametrize("k", [None, 3])
def test_only_near_pairs_leave_their_blocks(spark, monkeypatch, k):
    """With blocks smaller than a key's rows no pair is lost, and what isn't near, or not among the best of any block, is never given on."""
    import numpy as np
    from recallspark.operators import near

    monkeypatch.setattr(near, "BLOCK", 100)
    rng = np.random.default_rng(7)
    made = [("a" if i % 3 else "b", i, [float(x) for x in rng.normal(size=4)]) for i in range(600)] + [("a", 600, None), ("a", 601, [0.0] * 4), ("a", 602, [1.0, 2.0])]
    left = spark.createDataFrame(made[::4] + made[-3:], "chat_id string, l long, va array<double>")
    right = spark.createDataFrame(made, "chat_id string, r long, vb array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, v in made[:600]}
    cosines = {(i, j): float(unit[i] @ unit[j]) for c, i, _ in made[:600:4] for d, j, _ in made[:600] if c == d} | {(602, 602): 1.0}
    expected = {p for p, s in cosines.items() if s >= 0.8}
    if k:
        best = {i: sorted((s for (x, _), s in cosines.items() if x == i), reverse=True)[:k] for i in {i for i, _ in expected}}
        expected = {p for p in expected if cosines[p] >= best[p[0]][-1]}
    rows = [(r.l, r.r) for r in near.near(left, right, ["chat_id"], 0.8, k).collect()]
    assert len(rows) == len(set(rows)) and expected <= set(rows) and all(cosines[p] >= 0.8 - 1e-5 for p in rows)
    assert len(rows) == len(expected) if k is None else len(rows) <= 5 * len(expected)
