"""Similar events, reflections and near-duplicate pairs of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text, vector
from .. import staging
from ..staging import cut
from .near import near
from .near_sets import MAX_SENT, jaccards, key_candidates


def word_classes(memories: DataFrame, first: str = "id") -> DataFrame:
    """chat_id, id, rep, words: memories with the distinct words of their text; ``rep`` is the one of smallest ``first`` and id among those of the same words.

    Texts without words stand for themselves. A group of copies meets as digests of its words only.
    """
    rows = memories.select("chat_id", "id", F.col(first).alias("__o"), text.plain_words(F.col("summary")).alias("words"))
    rows = rows.withColumn("__k", F.when(F.size("words") > 0, F.unhex(F.sha2(F.array_join(F.array_sort("words"), "\n"), 256))).otherwise(F.col("id").cast("string").cast("binary")))
    rows = staging.written(rows, "word-sets")
    reps = rows.groupBy("chat_id", "__k").agg(F.min(F.struct("__o", "id")).alias("m")).select("chat_id", "__k", F.col("m.id").alias("rep"))
    # words stay where they are read: only copies are told their representative
    copies = rows.select("chat_id", "id", "__k").distinct().join(reps, ["chat_id", "__k"]).filter(F.col("id") != F.col("rep"))
    copies = staging.small(staging.written(copies.select("chat_id", "id", "__k", "rep"), "copies"), MAX_SENT)
    return rows.join(copies, ["chat_id", "id", "__k"], "left").select("chat_id", "id", F.coalesce("rep", "id").alias("rep"), "words")


def shared_word_candidates(left: DataFrame, right: DataFrame | None, at_least: float) -> DataFrame:
    """chat_id, l, r, similarity: pairs whose word sets have a Jaccard similarity of at least ``at_least``.

    Both sides hold chat_id, id and ``words`` (distinct); without ``right`` pairs l < r of one table are found. Give it one row for each set of
    words (``word_classes``): copies would all meet each other. Only what may be similar by its signature (``key_candidates``) is compared by its words, and only those words are shuffled.
    """
    def keyed(side: DataFrame, name: str) -> DataFrame:
        return side.filter(F.size("words") > 0).select("chat_id", F.col("id").alias(name), F.col("words").alias(f"{name}_words"))

    one, two = keyed(left, "l"), keyed(left if right is None else right, "r")
    met = staging.written(key_candidates(one, None if right is None else two, at_least), "candidates")
    return jaccards(met, one, two, at_least)


def against_store(new: DataFrame, stored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """chat_id, id, match: new events that repeat a stored memory, with the first such memory.

    They repeat it if half the Jaccard threshold is reached and the vectors' cosine is at the cosine threshold.
    """
    pairs = near(new.select("chat_id", F.col("id").alias("l"), F.col("embedding").alias("va")), stored.select("chat_id", F.col("id").alias("r"), F.col("embedding").alias("vb")), ["chat_id"], settings.dedup_cosine)
    words = text.plain_words(F.col("summary"))
    a = new.select("chat_id", F.col("id").alias("l"), F.col("embedding").alias("va"), words.alias("wa"))
    b = stored.select("chat_id", F.col("id").alias("r"), F.col("embedding").alias("vb"), "ord", words.alias("wb"))
    met = staging.written(pairs, "near-pairs").join(a, ["chat_id", "l"]).join(b, ["chat_id", "r"])
    # the vectors' cosine first, as it drops most of what the words would be compared for
    close = met.filter(vector.cosine(F.col("va"), F.col("vb")) >= settings.dedup_cosine).filter(text.jaccard(F.col("wa"), F.col("wb")) >= settings.dedup_jaccard / 2)
    return close.groupBy("chat_id", F.col("l").alias("id")).agg(F.min_by("r", F.struct("ord", "r")).alias("match"))


def count_mentions(stored: DataFrame, matched: DataFrame) -> DataFrame:
    """Stored memories with one more mention for each new event that repeated them."""
    more = matched.groupBy("chat_id", F.col("match").alias("id")).agg(F.count(F.lit(1)).alias("__more"))
    rows = stored.join(more, ["chat_id", "id"], "left")
    return rows.withColumn("mentions", F.coalesce(F.nullif("mentions", F.lit(0)), F.lit(1)) + F.coalesce("__more", F.lit(0))).drop("__more")


def within_batch(events: DataFrame, threshold: float = DEFAULTS.dedup_jaccard) -> DataFrame:
    """Events of which no earlier kept one of their chat is similar: greedy, in order of ``ord``.

    Of events with the same words only the first can stay: what drops it drops them all. Similar pairs of these come from a join; an
    event's fate only depends on those of earlier neighbours. Events without an earlier neighbour stay, neighbours of a
    kept one go, and the two steps repeat on what is undecided; each round decides at least the first event of every open chain.
    """
    classes = word_classes(events, "ord")
    sets = classes.filter(F.col("id") == F.col("rep")).select("chat_id", "id", "words")
    order = events.select("chat_id", F.col("id").alias("l"), F.col("ord").alias("lo"))
    pairs = shared_word_candidates(sets, None, threshold).join(order, ["chat_id", "l"]).join(order.toDF("chat_id", "r", "ro"), ["chat_id", "r"])
    earlier = (F.col("lo") < F.col("ro")) | ((F.col("lo") == F.col("ro")) & (F.col("l") < F.col("r")))
    edges = pairs.select("chat_id", F.when(earlier, F.col("l")).otherwise(F.col("r")).alias("l"), F.when(earlier, F.col("r")).otherwise(F.col("l")).alias("r"))
    open_ = cut(edges)
    gone = classes.filter(F.col("id") != F.col("rep")).select("chat_id", "id")
    while not open_.isEmpty():
        blocked = open_.select("chat_id", F.col("r").alias("l")).distinct()
        firsts = open_.select("chat_id", "l").distinct().join(blocked, ["chat_id", "l"], "left_anti")
        lost = cut(open_.join(firsts, ["chat_id", "l"], "left_semi").select("chat_id", F.col("r").alias("id")).distinct())
        gone = gone.unionByName(lost)
        known = lost.withColumnRenamed("id", "l")
        open_ = open_.join(firsts, ["chat_id", "l"], "left_anti").join(known, ["chat_id", "l"], "left_anti").join(known.withColumnRenamed("l", "r"), ["chat_id", "r"], "left_anti")
        open_ = cut(open_)
    return events.join(gone.distinct(), ["chat_id", "id"], "left_anti")


def judge_reflections(new: DataFrame, old: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """chat_id, id, verdict, match, similarity of new reflections against the old ones of their character.

    reject from 0.9 on, replace (the old one is archived) from 0.8 on, else add. New ones aren't compared with each other. Only the best of each pair of
    blocks leave their task (``near``); an old one whose vector can't be compared is at 0.
    """
    key, dim = ["chat_id", "who"], F.when(vector.norm(F.col("embedding")) > 0, F.size("embedding"))
    a = new.select("chat_id", F.col("id").alias("l"), F.lower("character").alias("who"), F.col("embedding").alias("va"), dim.alias("dim"))
    b = old.select("chat_id", F.lower("character").alias("who"), F.col("id").alias("r"), F.col("embedding").alias("vb"), "ord", dim.alias("dim"))
    met = staging.written(near(a, b, key, -2.0, 1), "near-pairs")
    pairs = met.join(a.select(*key, "l", "va"), [*key, "l"]).join(b.select(*key, "r", "vb", "ord"), [*key, "r"])
    pairs = pairs.select("chat_id", F.col("l").alias("id"), F.col("r").alias("match"), "ord", vector.cosine(F.col("va"), F.col("vb")).alias("similarity"))
    sizes = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    like = b.filter("dim is not null").groupBy(*key, "dim").agg(F.count(F.lit(1)).alias("same"))
    unlike = a.join(sizes, key).join(like, [*key, "dim"], "left").filter(F.col("n") > F.coalesce("same", F.lit(0)))
    nothing = unlike.select("chat_id", F.col("l").alias("id")).withColumns({"match": F.lit(None).cast(old.schema["id"].dataType), "ord": F.lit(None).cast(old.schema["ord"].dataType), "similarity": F.lit(0.0)})
    best = pairs.unionByName(nothing).groupBy("chat_id", "id").agg(F.max(F.struct("similarity", (-F.col("ord")).alias("o"), "match")).alias("b"))
    rows = new.select("chat_id", "id").join(best, ["chat_id", "id"], "left")
    s = F.coalesce("b.similarity", F.lit(0.0))
    verdict = F.when(s >= settings.reflection_reject, "reject").when(s >= settings.reflection_replace, "replace").otherwise("add")
    return rows.select("chat_id", "id", verdict.alias("verdict"), F.when(s >= settings.reflection_replace, F.col("b.match")).alias("match"), s.alias("similarity"))


def skip_reflection(recent: DataFrame, old: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """chat_id, character, skip: whether most of a character's three weightiest recent memories resemble an old reflection of theirs."""
    from . import ranking, scoring

    top = ranking.top_n(recent.filter(F.col("embedding").isNotNull()), ["chat_id", "character"], [F.desc(scoring.importance()), F.col("ord")], 3)
    b = old.select("chat_id", "character", F.col("embedding").alias("vb"))
    pairs = top.join(b, ["chat_id", "character"], "left").withColumn("s", vector.cosine(F.col("embedding"), F.col("vb")))
    per = pairs.groupBy("chat_id", "character", "id").agg(F.max(F.coalesce("s", F.lit(0.0))).alias("s"))
    return per.groupBy("chat_id", "character").agg((F.sum((F.col("s") >= settings.reflection_skip).cast("int")) >= F.ceil(F.count(F.lit(1)) / 2)).alias("skip"))


def review_pairs(memories: DataFrame, band: int = 15, low: float = 0.25, high: float = 0.6, characters: float = 0.3) -> DataFrame:
    """Pairs of memories of a type, fewer than ``band`` places apart in their chat, that share some words but not most.

    Places are cut into stretches of ``band``; a memory meets its own and the next stretch only.
    """
    from . import ranking

    # words are made once, where a memory is read, and both sides of the pairs are read from what is written
    told = memories.select("chat_id", "id", "type", "characters", "message_id", "ord", F.array_distinct(text.ascii_words(F.col("summary"))).alias("words"))
    placed = ranking.place(staging.written(told, "review-words"), "chat_id", "message_id", ["ord"], 1000)
    rows = staging.written(placed.select("chat_id", "id", "type", "characters", "words", "place", F.floor(F.col("place") / band).alias("stretch")), "review-places")
    right = rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns]).withColumn("at", F.explode(F.array(F.col("stretch2"), F.col("stretch2") - 1)))
    same = (F.col("chat_id") == F.col("chat_id2")) & (F.col("stretch") == F.col("at")) & (F.col("type") == F.col("type2"))
    pairs = rows.join(right, same).filter((F.col("place2") > F.col("place")) & (F.col("place2") - F.col("place") < band))
    shared = text.jaccard(F.col("characters"), F.col("characters2"))
    apart = (F.size("characters") > 0) & (F.size("characters2") > 0) & (shared < characters)
    # sets of n and m words share n / m at most; the overlap is taken once for each pair that this leaves
    n, m = F.size("words"), F.size("words2")
    near_size = (n > 0) & (m > 0) & (F.least(n, m) >= F.lit(low) * F.greatest(n, m)) if low > 0 else F.lit(True)
    both = F.explode(F.array(F.size(F.array_intersect("words", "words2")))).alias("both")
    found = pairs.filter(~apart & near_size).select("chat_id", F.col("id").alias("first"), F.col("id2").alias("second"), (n + m).alias("all"), both)
    found = found.select("chat_id", "first", "second", F.when(F.col("both") > 0, F.col("both") / (F.col("all") - F.col("both"))).otherwise(F.lit(0.0)).alias("overlap"))
    return found.filter((F.col("overlap") >= low) & (F.col("overlap") < high))
