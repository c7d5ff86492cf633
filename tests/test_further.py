"""Operators that no registered query with SQL covers: names, answers of models, retrieval, two-phase extraction."""

import json

import pytest
from pyspark.sql import functions as F

from recallspark import config, staging
from recallspark.functions import answers, language, text
from recallspark.operators import access, contradiction, graph, lexical, maintenance, reports, retrieval, scheduling, scoring
from recallspark.streaming import extraction


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ---- names and the graph


@pytest.mark.parametrize(("word", "expected"), [("ßlichen", "ẞlichen"), ("état", "État"), ("ﬁnal", "ﬁnal"), ("ᾳδης", "ᾼδης"), ("9lives", "9lives"), ("", "")])
def test_first_letter_becomes_one_capital(spark, word, expected):
    assert one(spark, text.capitalized(F.lit(word))) == expected


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("king aldric northern", "king aldric southern", True),  # two of three words
        ("alice", "alicia", False),  # a common run of 4 of 5
        ("ошейник", "ошейником", True),  # contained
        ("продуктовый магазин", "цветочный магазин", False),  # one of two words
        ("sword", "swords", True),
        ("the", "of", False),  # stop words only
        ("abcd", "abce", True),  # short keys: a run of 3 of 4
        ("castles", "castle", True),
        ("magic swords", "swords magical", True),  # by stems
        ("red fox", "blue dog", False),
    ],
)
def test_overlapping_names(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x = graph.name_parts(df, "a").select("a", "b", *[F.col(c).alias(f"x_{c}") for c in ("words", "stems", "key_stem")])
    both = graph.name_parts(x, "b")
    sides = [{c: F.col(f"{s}{c}") for c in ("words", "stems", "key_stem")} for s in ("x_", "")]
    assert both.select(graph.overlapping_names("a", "b", *sides).alias("v")).first()["v"] is expected
    assert both.select(graph.overlapping_names("b", "a", *sides[::-1]).alias("v")).first()["v"] is expected


def test_common_runs_are_longest_common_substrings(spark):
    def longest(a, b):
        return max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i : i + k] in b), default=0)

    words = ["castle", "castles", "oldcast", "xyz", "tle", "aaab", "baaa", "caste"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    for n in (1, 3, 4, 7):
        got = df.select("a", "b", graph.common_run(F.col("a"), F.col("b"), F.lit(n)).alias("v")).collect()
        assert all(r.v == (longest(r.a, r.b) >= n) for r in got)


def test_entities_meet_all_nodes_of_their_type(spark):
    """No word in common is needed: people merge by their vectors alone, things by vector and overlapping name."""
    nodes = spark.createDataFrame(
        [("a", "alexander", "PERSON", [1.0, 0.0]), ("a", "swords", "OBJECT", [0.0, 1.0]), ("a", "shield", "OBJECT", [0.1, 1.0]), ("b", "sasha", "PERSON", [1.0, 0.0])],
        "chat_id string, key string, type string, embedding array<float>",
    )
    new = spark.createDataFrame(
        [("a", "Sasha", "PERSON", [1.0, 0.05]), ("a", "Sword", "OBJECT", [0.05, 1.0]), ("a", "Lamp", "OBJECT", [0.0, 1.0]), ("a", "Swords", "OBJECT", None), ("a", "Alexander", "PLACE", [1.0, 0.0])],
        "chat_id string, name string, type string, embedding array<float>",
    )
    got = {r.name: (r.key, r.stage) for r in graph.resolve_entities(new, nodes).collect()}
    assert got == {"Sasha": ("alexander", "similar"), "Sword": ("swords", "similar"), "Lamp": ("lamp", "new"), "Swords": ("swords", "exact"), "Alexander": ("alexander", "exact")}


def test_graph_update(spark):
    nodes = spark.createDataFrame([("a", "king", "King", "PERSON", "rules", 1, [1.0, 0.0])], "chat_id string, key string, name string, type string, description string, mentions long, embedding array<float>")
    edges = spark.createDataFrame([], "chat_id string, source string, target string, weight long, description string")
    found = [("a", "His Majesty", "PERSON", "is old", [1.0, 0.01], 1), ("a", "Queen", "PERSON", "is wise", [0.0, 1.0], 2), ("a", "Unknown", "PERSON", "?", [0.0, 1.0], 3)]
    entities = spark.createDataFrame(found, "chat_id string, name string, type string, description string, embedding array<float>, ord long")
    said = [("a", "His Majesty", "Queen", "loves", 1), ("a", "Unknown", "Queen", "sees", 2), ("a", "King", "His Majesty", "is", 3), ("a", "Queen", "Nobody", "x", 4)]
    relations = spark.createDataFrame(said, "chat_id string, source string, target string, description string, ord long")
    n, e, r = graph.update_graph(nodes, edges, entities, relations)
    assert values(n, "key", "name", "mentions", "description") == [("king", "King", 2, "rules | is old"), ("queen", "Queen", 1, "is wise")]
    assert values(e, "source", "target", "weight") == [("king", "queen", 1)]
    assert values(r, "from_key", "to_key") == [("his majesty", "king")]


# ---- answers of models


@pytest.mark.parametrize(
    ("answer", "entities", "relations"),
    [
        ('{"entities":[{"name":"A","type":"person"},{"name":"","type":"PERSON"},{"name":"B","type":"DRAGON"}],"relationships":[{"source":"A","target":"B"},{"source":"A"}]}', [("A", "PERSON", "")], [("A", "B", "")]),
        ('[{"name":"C","type":"PLACE","description":"d"}]', [("C", "PLACE", "d")], []),
        ("<think>nothing here</think>", [], []),
        ('{"name":"f","arguments":{"entities":[{"name":"D","type":"OBJECT"}]}}', [("D", "OBJECT", "")], []),
    ],
)
def test_parse_graph(spark, answer, entities, relations):
    got = one(spark, answers.parse_graph(F.lit(answer)))
    assert [tuple(e) for e in got.entities] == entities and [tuple(r) for r in got.relationships] == relations


def test_parse_other_answers(spark):
    def run(parser, answer):
        return one(spark, parser(F.lit(answer)))

    assert run(answers.parse_reclassified, '[{"id":1,"is_transient":true},{"id":"b","is_transient":false},{"id":"1","is_transient":false}]') == {"1": False, "b": False}
    assert run(answers.parse_reclassified, '{"results":[{"id":"x","is_transient":true}]}') == {"x": True}
    assert run(answers.parse_reclassified, '[{"id":"x"}]') is None and run(answers.parse_reclassified, "no") is None
    got = run(answers.parse_reflections, '```json\n{"reflections":[{"question":"why (ev_1)","insight":"so","evidence_ids":["e"]},{"question":"","insight":"x"}]}\n```')
    assert [tuple(r) for r in got] == [("why", "so", ["e"])]
    assert run(answers.parse_reflections, "<think>hm</think>") == []
    assert run(answers.parse_community, '[{"title":"T","summary":"S","findings":["f"]}]').title == "T"
    assert run(answers.parse_community, '{"title":"T","summary":"S","findings":[]}') is None
    whole = "The story so far is long enough to be told in over fifty characters."
    assert run(answers.parse_global, json.dumps({"global_summary": whole})) == run(answers.parse_global, json.dumps(whole)) == run(answers.parse_global, whole) == whole
    assert run(answers.parse_global, '{"global_summary":"short"}') is None
    assert run(answers.parse_consolidated, '["they met"]') == "they met" == run(answers.parse_consolidated, '{"consolidated_description":"they met"}')
    sure = run(answers.parse_verdict, '{"contradicts":true,"confidence":7,"reason":"r"}')
    assert (sure.contradicts, sure.confidence, sure.newer_is_authoritative, sure.suggested_merge) == (True, 0.5, True, None)
    assert run(answers.parse_verdict, '{"confidence":0.4,"reason":"r"}') is None
    inner = json.dumps({"tool": "t", "arguments": json.dumps({"title": "T", "summary": "S", "findings": ["f"]})})
    assert run(answers.parse_community, inner).summary == "S"


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ('{"results":[{"index":1,"relevance_score":0.2},{"index":0,"relevance_score":0.9}]}', [(0, 0.9), (1, 0.2)]),
        ('{"data":[{"document_index":"2","score":"0.5"},{"score":0.7},{"position":9,"value":"x"}]}', [(1, 0.7), (2, 0.5), (2, 0.0)]),
        ('{"scores":[0.1,0.3,null]}', [(1, 0.3), (0, 0.1), (2, 0.0)]),
        ("{}", None), ("broken", None),
    ],
)
def test_parse_ranking(spark, payload, expected):
    got = one(spark, answers.parse_ranking(F.lit(payload), F.lit(3)))
    assert (got and [tuple(r) for r in got]) == expected or (expected is None and not got)


def test_keys_and_ids(spark):
    renamed = one(spark, answers.rename_keys(F.create_map(*[F.lit(x) for x in ("bob", 1, "BOB", 2, "x", 3)]), F.create_map(F.lit("bob"), F.lit("Bob"))))
    assert renamed == {"Bob": 2, "x": 3}
    ids = {r[0] for r in spark.range(50).select(answers.new_id()).collect()}
    assert len(ids) == 50 and all(i.startswith("mem_") for i in ids)


# ---- texts and settings


def test_labels(spark):
    def run(column):
        return one(spark, column)

    assert run(text.dossier_key(F.lit("The ‘King’s   Guard"))) == "the king guard"
    assert run(text.name_stems(F.lit("The running Castles"), language.stems)) == ["the", "run", "castl"]
    assert run(text.witnesses(F.array(F.lit("A"), F.lit("B")))) == "Witnesses: A, B" and run(text.witnesses(F.array().cast("array<string>"))) == ""
    assert run(text.emotion_source(F.lit(3), F.lit(5))) == "(from messages 3-5)" and run(text.emotion_source(F.lit(3), F.lit(3))) == "(from message 3)"
    assert run(text.day(F.lit(86_400_000))) == "1970-01-02" and run(text.day(F.lit(None).cast("long"))) == "Unknown"
    assert run(text.newest_lines(F.lit("a\n\n b\nc"), 2)) == ["c", " b"]
    rows = spark.createDataFrame([("en", 2, "b"), ("en", 1, "a"), ("ru", 3, "в")], "lang string, ord int, example string")
    assert text.examples(rows, "en").first()[0] == "a\n\nb" and text.examples(rows, "auto").first()[0] == "a\n\nb\n\nв"


def test_settings():
    assert config.changed(config.DEFAULTS) == {} and config.changed(config.Settings(alpha=0.5)) == {"alpha": (0.5, 0.7)}
    assert [config.calls_per_minute(v) for v in (0, 12, 99, "7", "x", None)] == [1, 12, 30, 7, 10, 10]


# ---- retrieval


def test_viewpoint(spark):
    chats = spark.createDataFrame([("g", "1", "Ann", "U"), ("s", None, "Bob", "U"), ("e", None, "Cyd", None)], "chat_id string, group_id string, main string, user string")
    present = spark.createDataFrame([("g", "Zoe"), ("s", "Dan"), ("s", "Eve")], "chat_id string, name string")
    assert values(retrieval.viewpoint(chats, present), "chat_id", "name") == [("e", "Cyd"), ("g", "Ann"), ("s", "Dan"), ("s", "Eve")]


def test_names_of_the_present_are_no_query_terms(spark):
    terms = spark.createDataFrame([(1, "ann"), (1, "lee"), (1, "castle"), (2, "ann")], "query_id int, term string")
    names = spark.createDataFrame([(1, "Ann Lee")], "query_id int, name string")
    assert values(retrieval.without_names(terms, names), "query_id", "term") == [(1, "castle"), (2, "ann")]


def test_rerank_without_an_answer_keeps_the_order(spark):
    scored = spark.createDataFrame([(1, "a", i, i + 1) for i in range(5)], "query_id int, chat_id string, id int, rank int")
    ranked = spark.createDataFrame([(1, "a", 3, 0.5), (1, "a", 3, 0.9), (1, "a", 1, 0.9), (1, "a", 77, 1.0)], "query_id int, chat_id string, index int, score double")
    order = lambda df: [r.id for r in df.orderBy("place").collect()]
    assert order(retrieval.rerank(scored, ranked)) == [1, 3, 0, 2, 4]
    assert order(retrieval.rerank(scored, ranked.limit(0))) == [0, 1, 2, 3, 4]
    assert order(retrieval.rerank(scored, ranked, window=2)) == [1, 0, 2, 3, 4]


def test_selection_with_a_reranker(spark):
    """The reranked order decides what fits, the scores of before decide which memories of importance 5 stay."""
    rows = [(1, "a", i, i, float(10 - i), 5 if i < 3 else 3, "recent", 10, ["x"], i, "s") for i in range(8)]
    scored = spark.createDataFrame(rows, "query_id int, chat_id string, id int, ord int, score double, importance int, bucket string, n_tokens int, characters array<string>, extraction_count int, summary string")
    ranked = spark.createDataFrame([(1, "a", 7, 0.9), (1, "a", 2, 0.8), (1, "a", 1, 0.7), (1, "a", 0, 0.6)], "query_id int, chat_id string, index int, score double")
    assert values(retrieval.select(scored, 40), "id") == [(0,), (1,), (3,), (4,)]
    assert values(retrieval.select(scored, 40, ranked), "id") == [(0,), (1,), (3,), (7,)]


def test_compact_scores(spark):
    rows = spark.createDataFrame([(1, "a", 1, 2.345678, 0.0, 1.0, 3, "x" * 200)], "query_id int, chat_id string, id int, score double, bm25_bonus double, frequency double, importance int, summary string")
    assert json.loads(retrieval.compact(rows).first().scores) == {"score": 2.35, "summary": "x" * 120}


# ---- contradictions, the store


def test_full_scan_skips_what_was_analysed(spark):
    rows = [("a", 1, 1, ["x", "y"], "they are friends", 1, False), ("a", 2, 2, ["x", "y"], "they hate each other", 9, False), ("a", 3, 3, ["x", "y"], "they trust each other", 80, False)]
    mem = spark.createDataFrame(rows, "chat_id string, id long, ord long, characters array<string>, summary string, extraction_count long, archived boolean")
    none = spark.createDataFrame([], "chat_id string, pair_key string")
    found = contradiction.full_scan(mem, none, 10)
    assert values(found, "older", "newer", "reason") == [(1, 2, "opposite"), (1, 3, "gap"), (2, 3, "opposite")]
    rest = contradiction.full_scan(mem, found.filter("reason = 'opposite'").select("chat_id", "pair_key"), 10)
    assert values(rest, "older", "newer") == [(1, 3)]
    assert contradiction.full_scan(mem, none, 1).first().reason == "opposite"


def test_store_changes(spark):
    mem = spark.createDataFrame([("a", 1), ("b", 2)], "chat_id string, id long")
    log = spark.createDataFrame([("a", 0, True, True), ("a", 1, True, False), ("b", 0, True, True)], "chat_id string, idx long, is_system boolean, hidden boolean")
    tables, shown = maintenance.drop_chat({"memories": mem}, log, "a")
    assert values(tables["memories"], "id") == [(2,)] and values(shown, "chat_id", "idx", "is_system") == [("a", 0, False), ("a", 1, True), ("b", 0, True)]
    states = spark.createDataFrame([("a", "X"), ("a", "Y")], "chat_id string, character string")
    assert values(maintenance.drop_states(states, states.filter("character = 'X'")), "character") == [("Y",)]
    groups = spark.createDataFrame([("a", 1, "t", "s", ["f"], [1.0]), ("a", 2, "t", "s", ["f"], [1.0])], "chat_id string, id long, title string, summary string, findings array<string>, embedding array<double>")
    new = maintenance.update_communities(groups, spark.createDataFrame([("a", 1, None, "s2", None)], "chat_id string, id long, title string, summary string, findings array<string>"))
    assert values(new, "id", "title", "summary", "embedding") == [(1, "t", "s2", None), (2, "t", "s", [1.0])]
    assert values(maintenance.drop_communities(groups, groups.filter("id = 1")), "id") == [(2,)]
    rows = spark.createDataFrame([("a", 1, None, True), ("a", 2, [2.0], True)], "chat_id string, id long, embedding array<double>, synced boolean")
    made = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [9.0])], "chat_id string, id long, embedding array<double>")
    assert values(maintenance.add_vectors(rows, made), "id", "embedding", "synced") == [(1, [1.0], False), (2, [2.0], True)]


def test_reports(spark):
    listing = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "chat_id string, id long, t string")
    got = {r.chat_id: json.loads(r.report) for r in reports.report(rows=listing, more=listing.filter("id = 1").drop("t")).collect()}
    assert got == {"a": {"rows": [{"id": 1, "t": "y"}, {"id": 2, "t": "x"}], "more": [{"id": 1}]}, "b": {"rows": [{"id": 3, "t": "z"}]}}
    groups = spark.createDataFrame([("a", 1, "T", ["x", "y"], None)], "chat_id string, id long, title string, node_keys array<string>, findings array<string>")
    assert values(reports.community_counts(groups), "members", "findings") == [(2, 0)]
    assert [str(len(reports.order_by(k))) for k in ("date", "importance", "story")] == ["2", "2", "2"]


# ---- extraction


def test_empty_batches_are_tried_again_and_given_up(spark):
    results = spark.createDataFrame([("a", "k1", 3), ("a", "k2", 0), ("a", "k3", 0), ("a", "k4", 0)], "chat_id string, batch_key string, n_events int")
    tries = spark.createDataFrame([("a", "k3", 1), ("a", "k4", 2)], "chat_id string, batch_key string, tries int")
    assert values(extraction.judge_results(results, tries), "batch_key", "tries", "action") == [("k1", 0, "done"), ("k2", 1, "retry"), ("k3", 2, "retry"), ("k4", 2, "give up")]
    keys = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "f array<string>").select(extraction.batch_key(F.col("f")).alias("k")).collect()
    assert keys[0].k == keys[1].k


def test_two_phases(spark, tmp_path):
    """Events survive a failure to enrich them, and are enriched later; a batch that runs again changes nothing."""
    schema, fail = "chat_id string, text string", [True]

    def enrich(events):
        if fail[0]:
            raise RuntimeError("no connection")
        return events.withColumn("length", F.length("event"))

    sink = extraction.TwoPhaseSink(spark, str(tmp_path / "out"), lambda rows: rows.select("chat_id", F.upper("text").alias("event")), enrich)
    assert sink.pending() == [] and sink.events() is None
    folder = tmp_path / "in"

    def run(*texts):
        spark.createDataFrame([("a", t) for t in texts], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()

    run("one", "two")
    assert values(sink.events(), "event") == [("ONE",), ("TWO",)] and sink.pending() == [0] and sink.catch_up() == [0]
    fail[0] = False
    run("three")
    assert sink.pending() == [0] and sink.catch_up() == [] and sink.pending() == []
    assert values(sink.enriched(), "event", "length") == [("ONE", 3), ("THREE", 5), ("TWO", 3)]
    sink(spark.createDataFrame([("a", "three")], schema), 1)
    assert values(sink.events(), "event") == [("ONE",), ("THREE",), ("TWO",)]
    # an attempt that was lost before the manifest names it doesn't count
    spark.createDataFrame([("a", "LOST")], "chat_id string, event string").write.parquet(f"{sink.folder}/events/batch=1/attempt=a0")
    assert values(sink.events(), "event") == [("ONE",), ("THREE",), ("TWO",)] and sink.pending() == []
    fail[0] = True
    sink(spark.createDataFrame([], schema), 2)
    fail[0] = False
    assert sink.pending() == [2] and sink.catch_up() == [] and sink.pending() == [] and len(values(sink.enriched(), "event")) == 3


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session())


def test_next_batch(spark):
    """By budget or turns, back to a whole turn or on to one, with the last turn held back."""
    roles = "ubububub"
    log = spark.createDataFrame([("a", i, r == "u", False, 10, f"f{i}") for i, r in enumerate(roles)], "chat_id string, idx long, is_user boolean, is_system boolean, n_tokens long, fingerprint string")
    none = log.limit(0)

    def taken(*args, **kwargs):
        return [i for (i,) in values(scheduling.next_batch(log, *args, **kwargs), "idx")]

    assert taken(none, 30) == [0, 1]  # three messages, back to the end of the first turn
    assert taken(none, 40) == [0, 1, 2, 3]
    assert taken(none, 10) == [0, 1]  # the first message alone is enough: on to the end of its turn
    assert taken(none, 1000) == []
    assert taken(none, 1000, max_turns=2) == [0, 1, 2, 3]
    assert taken(none, 70) == [0, 1, 2, 3, 4, 5]  # the last turn is held back
    assert taken(log.filter("idx < 2"), 20) == [2, 3]
    assert taken(none, 1000, everything=True) == list(range(8))


def test_orphans(spark):
    log = spark.createDataFrame([("a", 0, "f0"), ("a", 1, "f1")], "chat_id string, idx long, fingerprint string")
    rows = [("a", 1, ["f0", "x"], []), ("a", 2, ["x"], [0]), ("a", 3, [], [5]), ("a", 4, [], [1]), ("a", 5, [], []), ("b", 6, ["x"], [])]
    mem = spark.createDataFrame(rows, "chat_id string, id long, fingerprints array<string>, message_ids array<long>")
    assert values(access.orphaned(mem, log), "id") == [(2,), (3,)]


@pytest.mark.parametrize(
    ("transient", "half_life", "remaining", "label"),
    [(False, 5.0, 3.0, ""), (True, 5.0, 0.4, "Faded"), (True, 5.0, 0.9, "Fades in ~1 extraction"), (True, 5.0, 48.0, "Fades in ~50 extractions"), (True, 5.0, 104.0, "Fades in ~100 extractions"),
     (True, 0.5, None, "Fades: <1 extraction"), (True, 24.95, None, "Fades: ~25 extractions"), (None, 5.0, 1.0, "")],
)
def test_fading_labels(spark, transient, half_life, remaining, label):
    df = spark.createDataFrame([(transient, half_life, remaining)], "t boolean, h double, r double")
    assert df.select(scoring.fading_label(F.col("t"), F.col("h"), F.col("r")).alias("v")).first()["v"] == label


def test_idf_cache_and_mentions(spark):
    mem = spark.createDataFrame([("a", 1, "sword castle", False), ("a", 2, "sword", False), ("a", 3, "dragon", True)], "chat_id string, id long, summary string, archived boolean")
    assert values(lexical.idf_cache(mem), "term", "df") == [("castle", 1), ("sword", 2)]
    phrases = spark.createDataFrame([(1, "the of")], "query_id int, phrase string")
    stop = spark.createDataFrame([("a", 1, "the of")], "chat_id string, id long, summary string")
    corpus = lexical.corpus_size(stop)
    assert lexical.phrase_bonus(stop, phrases, lexical.idf_table(lexical.postings(stop), corpus), corpus=corpus).first().bonus == pytest.approx(10 * 0.6931471805599453)
    nodes = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("a", "z", None)], "chat_id string, key string, mentions long")
    assert [r.key for r in reports.most_mentioned(nodes, 2).orderBy("rank").collect()] == ["y", "x"]


def test_index_recall(spark):
    """At least nine tenths of what brute force finds, at the exact similarities; every usable vector is in one list."""
    from recallspark.plans import registry

    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.id): r.similarity for r in registry.QUERIES["cosine_topk"](spark, sf).collect()}
    found = {(r.query_id, r.id): r.similarity for r in registry.QUERIES["indexed_topk"](spark, sf).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(found[k] - exact[k]) < 1e-9 for k in exact.keys() & found.keys())
    odd = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)] + [(90, None), (91, [0.0, 0.0])], "id long, embedding array<float>")
    centroids, members = scoring.index_lists(odd, 3)
    assert values(members, "id") == sorted(((i,) for i in range(40)), key=str) and centroids.count() <= 3
