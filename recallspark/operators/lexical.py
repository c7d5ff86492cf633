"""Lexical retrieval: corpus statistics, query terms and BM25, for each chat at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .. import staging
from ..functions import text

#: Phrases that are sent to every task at once, and letters on either side of a blank by which they are looked up.
MAX_PHRASES, LETTERS = 100_000, 3
#: Of so many terms one is looked at first, where the rarest one of a chat is wanted.
RARE_SHARE = 64


def tokenized(memories: DataFrame, stem=None) -> DataFrame:
    """chat_id, id, dl, tokens: each memory's terms and their number. Written once (``staging.written``) it serves all that follows."""
    return memories.select("chat_id", "id", text.tokens(F.col("summary"), stem).alias("tokens")).withColumn("dl", F.size("tokens"))


def told(memories: DataFrame, stem=None) -> DataFrame:
    """Tokenized memories as they are, others tokenized."""
    return memories if "tokens" in memories.columns else tokenized(memories, stem)


def postings(memories: DataFrame, terms: DataFrame | None = None, stem=None) -> DataFrame:
    """chat_id, id, term, tf, dl: how often a term occurs in a memory (as it is or tokenized), and the memory's length in terms.

    Where only the terms of some queries are asked for, the others are left out before anything is shuffled.
    """
    rows = told(memories, stem).select("chat_id", "id", "dl", F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(staging.small(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("chat_id", "id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_size(memories: DataFrame, stem=None) -> DataFrame:
    """chat_id, n_docs, avg_dl of all memories; those without terms count."""
    return told(memories, stem).select("chat_id", "dl").groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def idf_table(posted: DataFrame, corpus: DataFrame) -> DataFrame:
    """chat_id, term, df, idf = ln((N - df + 0.5) / (df + 0.5) + 1)."""
    return with_idf(posted.groupBy("chat_id", "term").agg(F.count(F.lit(1)).alias("df")), corpus)


def with_idf(df: DataFrame, corpus: DataFrame) -> DataFrame:
    n = F.col("n_docs")
    return df.join(corpus.select("chat_id", "n_docs"), "chat_id").select(
        "chat_id", "term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
    )


def idf_cache(memories: DataFrame, stem=None) -> DataFrame:
    """The idf table of all memories that aren't archived, written once; later queries read it in place of the memories."""
    told = staging.written(tokenized(memories.filter(~F.coalesce("archived", F.lit(False))), stem), "tokens")
    return staging.written(idf_table(postings(told), corpus_size(told)), "idf")


def query_terms(queries: DataFrame, stem=None) -> DataFrame:
    """query_id, term, count: the terms of each query text with their multiplicity."""
    rows = queries.select("query_id", F.explode(text.tokens(F.col("text"), stem)).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("count"))


def tiered_terms(terms: DataFrame, vocabulary: DataFrame | None, settings: Settings = DEFAULTS) -> DataFrame:
    """Multiplicity by tier: a term that the corpus has counts ceil(boost * 0.6) times, another ceil(boost * 0.4) times, however often it is said.

    Without a vocabulary the terms keep their counts. An empty vocabulary gives no terms.
    """
    if vocabulary is None:
        return terms
    known = vocabulary.select("term").distinct().withColumn("known", F.lit(True))
    if known.isEmpty():
        return terms.limit(0)
    times = F.ceil(F.lit(settings.entity_boost) * F.when(F.col("known"), settings.grounded_ratio).otherwise(settings.free_ratio))
    return terms.join(known, "term", "left").select("query_id", "term", times.cast("long").alias("count"))


def entity_terms(entities: DataFrame, settings: Settings = DEFAULTS, stem=None) -> DataFrame:
    """Terms of recognised entities (query_id, name, weight): single words count twice ceil(weight * boost) times, names of several words are phrases."""
    single = entities.filter(~F.contains(F.trim("name"), F.lit(" ")))
    times = 2 * F.ceil(F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)) * settings.entity_boost).cast("long")
    rows = single.select("query_id", times.alias("times"), F.explode(text.tokens(F.col("name"), stem)).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.sum("times").alias("count"))


def weigh_terms(terms: DataFrame, idf: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, chat_id, term, idf, multiplicity = max(1, round(count * idf / ln(N + 1))) for the terms that a chat has."""
    joined = terms.join(idf, "term").join(corpus.select("chat_id", "n_docs"), "chat_id")
    weight = F.greatest(F.lit(1.0), text.half_up(F.col("count") * F.col("idf") / F.log(F.col("n_docs") + 1)))
    return joined.select("query_id", "chat_id", "term", "idf", weight.cast("double").alias("multiplicity"))


def bm25(weighted: DataFrame, posted: DataFrame, corpus: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, chat_id, id, bm25: the sum over query terms of multiplicity * idf * saturated frequency."""
    k1, b = settings.k1, settings.b
    rows = posted.join(weighted, ["chat_id", "term"]).join(corpus.select("chat_id", "avg_dl"), "chat_id")
    part = F.col("multiplicity") * F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return rows.groupBy("query_id", "chat_id", "id").agg(F.sum(part).alias("bm25"))


def normalized(scores: DataFrame, value: str = "bm25") -> DataFrame:
    """``value`` divided by the largest of its query and chat, as ``<value>_norm``; the maximum is grouped and joined back, so no group is gathered."""
    most = scores.groupBy("query_id", "chat_id").agg(F.greatest(F.max(value), F.lit(1e-9)).alias("__max"))
    return scores.join(most, ["query_id", "chat_id"]).withColumn(f"{value}_norm", F.col(value) / F.col("__max")).drop("__max")


def phrase_bonus(memories: DataFrame, phrases: DataFrame, idf: DataFrame, settings: Settings = DEFAULTS, corpus: DataFrame | None = None) -> DataFrame:
    """query_id, chat_id, id, bonus: phrase boost times the largest idf of the chat for each phrase (query_id, phrase) that a memory has.

    In a chat without an idf that is ln(N + 1), where ``corpus`` gives its size; otherwise it has no bonus.

    Memories are first matched by the phrase's rarest looking (longest) word, so that only those with the word are searched.
    """
    longest = F.element_at(F.array_sort(F.filter(text.words(F.col("phrase")), lambda w: F.length(w) > 0), lambda a, b: F.length(b) - F.length(a)), 1)
    keyed = phrases.withColumn("word", longest).filter(F.col("word").isNotNull())
    said = memories.select("chat_id", "id", "summary", F.explode(F.array_distinct(text.words(F.col("summary")))).alias("word"))
    said = said.join(keyed.select("word").distinct(), "word", "left_semi")
    hits = said.join(keyed, "word").filter(text.has_phrase(F.col("summary"), F.col("phrase")))
    most = idf.groupBy("chat_id").agg(F.max("idf").alias("max_idf"))
    if corpus is not None:
        most = corpus.join(most, "chat_id", "left").select("chat_id", F.coalesce("max_idf", F.log(F.col("n_docs") + 1)).alias("max_idf"))
    return hits.join(most, "chat_id").groupBy("query_id", "chat_id", "id").agg((F.count(F.lit(1)) * settings.phrase_boost * F.first("max_idf")).alias("bonus"))


def flat(text_: Column) -> Column:
    """Lower case, white space as single blanks, without punctuation: the form in which phrases are looked for."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text_, F.lit(""))), r"\s+", " "), r"[^\p{L}\p{N}\s]", ""))


def positions(memories: DataFrame) -> DataFrame:
    """chat_id, id, words: the words of the flat summaries in their places.

    Words stand between single blanks; where punctuation stood alone there is an empty word, so that words beside each other differ by one in place.
    """
    return memories.select("chat_id", "id", F.split(flat(F.col("summary")), " ").alias("words"))


def _anchors(phrases: DataFrame) -> DataFrame:
    """phrase, said, k, j, a, b, key: each phrase in its flat form of ``k`` words, and letters by which it is looked up: ``a`` before and ``b`` after the blank behind its word ``j``.

    The first word may be the end of a word of a text and the last the start of one, as phrases are looked for in running text; those between are whole. Of the blanks of a phrase
    that with the most letters is taken. A phrase of one word, which may stand within a word, has no blank; it is looked up by its first letters, and b is -1.
    """
    asked = phrases.select("phrase").distinct().filter((F.instr(F.trim("phrase"), " ") > 0) & (F.length(flat(F.col("phrase"))) > 0))
    split = asked.select("phrase", flat(F.col("phrase")).alias("said")).withColumn("p", F.split("said", " ")).withColumn("k", F.size("p"))

    def blank(j: Column) -> Column:
        before, after = F.get("p", j), F.get("p", j + 1)
        # letters of a whole word that is shorter are all that the word has
        a = F.when(j == 0, F.least(F.length(before), F.lit(LETTERS))).otherwise(F.lit(LETTERS))
        b = F.when(j == F.col("k") - 2, F.least(F.length(after), F.lit(LETTERS))).otherwise(F.lit(LETTERS))
        x, y = F.right(before, a), F.left(after, b)
        return F.struct((F.length(x) + F.length(y)).alias("known"), (-j).alias("j"), a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"))

    first = F.left("said", F.lit(LETTERS))
    alone = F.struct(F.lit(0).alias("known"), F.lit(0).alias("j"), F.length(first).alias("a"), F.lit(-1).alias("b"), first.alias("x"), F.lit("").alias("y"))
    best = F.when(F.col("k") == 1, alone).otherwise(F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.col("k") - 2, F.lit(0))), blank)))
    rows = split.withColumn("m", best).select("phrase", "said", "k", (-F.col("m.j")).alias("j"), "m.a", "m.b", F.xxhash64("m.a", "m.b", "m.x", "m.y").alias("key"))
    return staging.written(rows, "phrase-anchors")


def phrase_matches(phrases: DataFrame, placed: DataFrame) -> DataFrame:
    """phrase, chat_id, id of the memories that have a phrase, by the places of words (``positions``); the same as ``text.has_phrase`` tells, without searching a text.

    The letters around each blank of a text are looked up among those of the phrases (``_anchors``), which are sent to every task, and where they are found the words around are
    compared. So only what is found is shuffled, however many different words there are.
    Only phrases of several words count, and none that is punctuation alone.
    """
    anchors = _anchors(phrases)
    n, shapes = anchors.count(), sorted(map(tuple, anchors.select("a", "b").distinct().collect()))
    if n <= MAX_PHRASES:
        met = _met(anchors, placed, shapes)
    else:
        placed, blocks, met = staging.written(placed, "positions"), -(-2 * n // MAX_PHRASES), None
        for i in range(blocks):
            some = _met(anchors.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == i), placed, shapes)
            met = some if met is None else met.unionByName(some)
    return met.distinct()


def _met(anchors: DataFrame, placed: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """phrase, chat_id, id for each place where a phrase stands; ``shapes`` are the (a, b) of the anchors."""
    places, after = placed.select("chat_id", "id", "words", F.posexplode("words").alias("at", "word")), F.get("words", F.col("at") + 1)

    def key(a: int, b: int, x: Column, y: Column) -> Column:
        return F.xxhash64(F.lit(a), F.lit(b), x, y)

    def within(a: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("word") - a + 1), lambda i: key(a, -1, F.substr("word", i, F.lit(a)), F.lit("")))

    around = [key(a, b, F.right("word", F.lit(a)), F.left(after, F.lit(b))) for a, b in shapes if b >= 0]
    ways = [(F.col("at") < F.size("words") - 1, F.array(*around))] if around else []
    ways += [(F.length("word") >= a, within(a)) for a, b in shapes if b < 0]
    # k words have as many blanks as a phrase of k words, so it stands in them from the first to the last or not at all
    window = F.array_join(F.slice("words", F.greatest(F.col("at") - F.col("j"), F.lit(0)) + 1, F.col("k")), " ")
    found = None
    for usable, keys in ways:
        met = places.filter(usable).withColumn("key", F.explode(keys)).join(F.broadcast(anchors), "key")
        met = met.filter(F.contains(window, F.col("said"))).select("phrase", "chat_id", "id")
        found = met if found is None else found.unionByName(met)
    return placed.select(F.lit("").alias("phrase"), "chat_id", "id").limit(0) if found is None else found


def greatest_idf(told: DataFrame, corpus: DataFrame) -> DataFrame:
    """chat_id, max_idf over all terms of a chat, that is of its rarest; ln(N + 1) in a chat without terms.

    No term is in fewer than one memory. So a chat is settled by any such term, looked for among one in RARE_SHARE, and all terms are counted in the other chats only.
    """
    some = staging.written(_least_df(told, RARE_SHARE), "some-df")
    settled = some.filter("df = 1")
    rest = told.join(staging.small(settled.select("chat_id")), "chat_id", "left_anti")
    least = settled.unionByName(_least_df(rest))
    n, d = F.col("n_docs"), F.col("df")
    return corpus.join(least, "chat_id", "left").select("chat_id", F.coalesce(F.log((n - d + 0.5) / (d + 0.5) + 1), F.log(n + 1)).alias("max_idf"))


def _least_df(told: DataFrame, share: int = 1) -> DataFrame:
    """chat_id, df: the fewest memories of a chat that a term is in, over all terms or one in ``share``."""
    tokens = F.col("tokens") if share == 1 else F.filter("tokens", lambda w: F.pmod(F.xxhash64(w), F.lit(share)) == 0)
    df = told.select("chat_id", F.explode(F.array_distinct(tokens)).alias("term")).groupBy("chat_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.groupBy("chat_id").agg(F.min("df").alias("df"))


def mentioned_entities(messages: DataFrame, names: DataFrame, active: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """chat_id, name, weight: the entities that the last messages of each chat speak of.

    ``messages`` (chat_id, back, mes) holds each message's distance from the newest, ``names`` (chat_id, word, name) which name a word
    stands for, ``active`` (chat_id, name) who is present. A mention weighs 1 - back * step, once in a message; active names get 3 more;
    a name in over half of the messages is dropped; the heaviest stay.
    """
    recent = messages.filter(F.col("back") < settings.entity_window)
    scanned = recent.groupBy("chat_id").agg(F.count(F.lit(1)).alias("scanned"))
    said = recent.select("chat_id", "back", F.explode(F.array_distinct(F.filter(text.words(F.col("mes")), lambda w: F.length(w) > 2))).alias("word"))
    hits = said.join(names, ["chat_id", "word"]).select("chat_id", "back", "name").distinct()
    weight = F.sum(1 - F.col("back") * settings.recency_step).alias("weight")
    found = hits.groupBy("chat_id", "name").agg(weight, F.count(F.lit(1)).alias("in_messages"))
    extra = active.filter(F.length("name") >= 2).select("chat_id", "name").distinct().withColumn("extra", F.lit(3.0))
    found = found.join(extra, ["chat_id", "name"], "full").join(scanned, "chat_id")
    found = found.filter(F.coalesce("in_messages", F.lit(0)) <= F.col("scanned") * 0.5)
    found = found.select("chat_id", "name", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("weight"))
    order = Window.partitionBy("chat_id").orderBy(F.desc(F.round("weight", 9)), "name")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= settings.top_entities)


def vocabulary(memories: DataFrame, stem=None) -> DataFrame:
    """chat_id, term: all terms of the corpus."""
    return memories.select("chat_id", F.explode(F.array_distinct(text.tokens(F.col("summary"), stem))).alias("term")).distinct()


def tail(column: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return F.right(F.trim(column), F.lit(n))
