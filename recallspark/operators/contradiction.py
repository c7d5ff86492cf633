"""Sentiment of memories and contradictions between those of the same characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import staging
from ..config import DEFAULTS
from ..functions import text

# Words and phrases of liking and of hostility, and negators, in English and Russian.
POSITIVE = (
    "friend friends friendly allied ally allies love loves loved loving affection affectionate trust trusts trusted trusting trustworthy "
    "close closer closest bonded bond reconciled reconciliation reconnected reunion peace peaceful harmonious harmony forgave forgiven forgiveness forgiving "
    "loyal loyalty devoted devotion kind kindness caring care cares supportive support helped helps helping grateful gratitude appreciative appreciation "
    "warm warmer warmth gentle respect respects respected respectful admire admires admiration protective protects protected protection "
    "comfort comforts comforted comforting apologized apology sorry accepted acceptance "
    "друг друзья друзьями другу другом подруга подруги подругу подругой дружба дружеский дружелюбный любовь любит любимый любимая любят "
    "доверие доверяет доверенный близкий близко сблизились мир мирный примирение примирились помирились прощение простил простила "
    "верный верность преданный добрый доброта забота заботливый поддержка поддерживает благодарный благодарность теплый тепло нежный нежность "
    "уважение уважает защищает защита извинился извинилась извинение"
).split()
NEGATIVE = (
    "enemy enemies hostile hostility hate hates hated hatred hating distrust distrusts distrusted distrustful betrayed betrayal betray betrays "
    "angry anger furious rage enraged fought fight fighting fights argued argument argue argues arguing conflict conflicting clashed clash "
    "rival rivals rivalry rivaling unfriendly cold colder distant distance rejected rejection reject rejects resent resents resentment resentful "
    "suspicious suspicion wary feud feuding bitter bitterness grudge grudges antagonistic antagonism opposed opposition opposing "
    "dislike dislikes disliked estranged alienated alienation abandoned abandonment abandon threat threatened threatening threatens "
    "violent violence attacked attack "
    "враг враги враждебный вражда ненависть ненавидит ненавижу недоверие недоверчивый предал предала предательство злой злость злится ярость "
    "ссора ссорился ссорилась поссорились конфликт конфликтовал соперник соперники соперничество недружелюбный холодный отдаленный "
    "отверг отвергла отвержение обида обиженный обижена подозрение подозрительный злопамятный неприязнь покинул покинула бросил бросила "
    "угроза угрожает напал напала нападение"
).split()
POSITIVE_PHRASES = ["made up", "made peace", "became friends", "grew closer"]
NEGATIVE_PHRASES = ["broke up", "fell out", "turned against", "became enemies", "не доверяет", "в гневе"]
NEGATORS = (
    "not no never without neither nor barely hardly stopped stop ceased quit doesn didn don isn wasn aren weren hasn haven hadn wouldn couldn shouldn ain "
    "не нет ни никогда без перестал перестала прекратил прекратила"
).split()
WINDOW = 3


def sentiment(summary: Column) -> Column:
    """positive, negative or neutral; a word with a negator among the three words before it doesn't count, and mixed signals are neutral.

    Phrases count at their first place only.
    """

    def count(found: Column, words: list[str], phrases: list[str]) -> Column:
        def hit(word: Column, i: Column) -> Column:
            near = F.slice(found, F.greatest(F.lit(1), i + 1 - WINDOW), F.least(i, F.lit(WINDOW)))
            return F.when(word.isin(*words), ~F.exists(near, lambda n: n.isin(*NEGATORS))).otherwise(False)

        total = F.size(F.filter(found, hit))
        padded = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
        for phrase in phrases:
            at = F.instr(padded, f" {phrase} ")
            before = F.filter(F.split(F.trim(F.substr(padded, F.lit(1), at)), " "), lambda w: w != "")
            near = F.slice(before, F.greatest(F.lit(1), F.size(before) - WINDOW + 1), F.lit(WINDOW))
            total = total + F.when(at > 0, (~F.exists(near, lambda n: n.isin(*NEGATORS))).cast("int")).otherwise(0)
        return total

    def of(found: Column) -> Column:
        return _verdict(count(found, POSITIVE, POSITIVE_PHRASES), count(found, NEGATIVE, NEGATIVE_PHRASES))

    # Most texts have no word of either list, which one pass tells. The array of one gives the words a name, so that they are not found for every word again.
    single = sorted({w for p in [*POSITIVE, *NEGATIVE, *POSITIVE_PHRASES, *NEGATIVE_PHRASES] for w in p.split(" ")})
    some = F.arrays_overlap(text.words(summary), F.array(*[F.lit(w) for w in single]))
    return F.when(some, F.element_at(F.transform(F.array(text.words(summary)), of), 1)).otherwise(F.lit("neutral"))


def _verdict(good: Column, bad: Column) -> Column:
    return F.when((good > 0) & (bad == 0), "positive").when((bad > 0) & (good == 0), "negative").otherwise("neutral")


def group_key(characters: Column) -> Column:
    """The sorted, lower-case characters of a memory as one key."""
    return F.array_join(F.array_sort(F.transform(characters, lambda c: F.trim(F.lower(c)))), "|")


def recency() -> Column:
    return F.coalesce(*[F.col(c) for c in ("extraction_count",)], F.lit(0))


def contradicted(memories: DataFrame) -> DataFrame:
    """chat_id and id of memories that a newer one of the same characters and the opposite sentiment overrules.

    The side with the newest memory wins its group and all of the other side lose; equal recency decides nothing. Groups are reduced to
    two maxima and joined back.
    """
    rows = memories.filter(F.size("characters") >= 2).select("chat_id", "id", group_key(F.col("characters")).alias("group"), sentiment(F.col("summary")).alias("mood"), recency().alias("at"))
    rows = staging.written(rows.filter(F.col("mood") != "neutral"), "moods")  # told once, though read twice
    newest = rows.groupBy("chat_id", "group").agg(*[F.max(F.when(F.col("mood") == m, F.col("at"))).alias(m) for m in ("positive", "negative")])
    loser = F.when(F.col("positive") > F.col("negative"), "negative").when(F.col("negative") > F.col("positive"), "positive")
    lost = newest.select("chat_id", "group", loser.alias("mood")).filter(F.col("mood").isNotNull())
    return rows.join(lost, ["chat_id", "group", "mood"]).select("chat_id", "id")


def without_contradicted(memories: DataFrame) -> DataFrame:
    return memories.join(contradicted(memories), ["chat_id", "id"], "left_anti")


def character_pairs(memories: DataFrame) -> DataFrame:
    """chat_id, first, second, id: each pair of different characters of a memory, in order."""
    names = F.array_sort(F.array_distinct(F.transform("characters", lambda c: F.trim(F.lower(c)))))
    one = memories.select("chat_id", "id", names.alias("names"))
    pairs = one.select("*", F.posexplode("names").alias("i", "first")).select("*", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("second"))
    return pairs.select("chat_id", "first", "second", "id")


def suspicious_pairs(memories: DataFrame, per_group: int = 5, gap: int = 50) -> DataFrame:
    """chat_id, first, second, older, newer, reason: pairs of memories of two characters that deserve a closer look.

    An opposite sentiment pairs each side's newest memories with the other side's newest ones, ``per_group`` in all; the oldest and
    the newest memory of a group are paired if ``gap`` clock ticks lie between them. A group is cut to its newest rows of each
    mood before pairs are made, so their number grows with the groups only.
    """
    rows = character_pairs(memories).join(memories.select("chat_id", "id", sentiment(F.col("summary")).alias("mood"), recency().alias("at"), "ord"), ["chat_id", "id"])
    key = ["chat_id", "first", "second"]
    from . import ranking

    moody = ranking.top_n(rows.filter("mood <> 'neutral'"), [*key, "mood"], [F.desc("at"), F.desc("ord")], per_group)
    a = moody.select(*key, F.col("id").alias("id1"), F.col("mood").alias("m1"), F.col("at").alias("t1"))
    b = moody.select(*key, F.col("id").alias("id2"), F.col("mood").alias("m2"), F.col("at").alias("t2"))
    opposite = a.join(b, key).filter("m1 = 'negative' and m2 = 'positive'")
    older = F.when(F.col("t1") <= F.col("t2"), F.col("id1")).otherwise(F.col("id2"))
    newer = F.when(F.col("t1") <= F.col("t2"), F.col("id2")).otherwise(F.col("id1"))
    opposite = opposite.select(*key, older.alias("older"), newer.alias("newer"), F.greatest("t1", "t2").alias("t"))
    opposite = opposite.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("t"), "older", "newer"))).filter(F.col("r") <= per_group)
    ends = rows.groupBy(*key).agg(F.min(F.struct("at", "id")).alias("lo"), F.max(F.struct("at", "id")).alias("hi")).filter(F.col("hi.at") - F.col("lo.at") >= gap)
    far = ends.select(*key, F.col("lo.id").alias("older"), F.col("hi.id").alias("newer"))
    seen = opposite.select(*key, "older", "newer")
    return seen.withColumn("reason", F.lit("opposite")).unionByName(far.join(seen, [*key, "older", "newer"], "left_anti").withColumn("reason", F.lit("gap")))


#: Stored memories that a list is cut to before it meets the new ones, and pairs that a task makes, about.
LIST, PAIRS = 4096, 5_000_000


def against_new(new: DataFrame, stored: DataFrame) -> DataFrame:
    """chat_id, id, other, place: for each new memory the stored ones that may contradict it, in their order.

    They share a character with it, whatever the case, are events that aren't archived, and both name two characters or more and tell opposite sentiments.

    New memories of a chat that name the same characters and are of one mind have one list, but for themselves. So lists are made and put in order once for each such kind, and their pairs with the new
    memories are made last, in cells of bounded size: no pair is shuffled, grouped or sorted. Their number grows with the square of a chat, as that is the result.
    """
    from .. import staging
    from . import ranking

    def told(df: DataFrame, name: str) -> DataFrame:
        who = F.array_sort(F.array_distinct(F.filter(F.transform("characters", lambda c: F.lower(c)), lambda c: c.isNotNull())))
        rows = df.filter(F.size("characters") >= 2).select("chat_id", F.col("id").alias(name), "ord", sentiment(F.col("summary")).alias("mood"), who.alias("names"))
        return rows.filter(F.col("mood") != "neutral")

    def by_name(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("chat_id", "mood", *columns, F.explode("names").alias("who"))

    kind = ["chat_id", "mood", "names"]
    fresh = staging.written(told(new, "id").select("id", *kind).distinct(), "new-told")
    kinds = staging.written(fresh.select(*kind).distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    opposite = F.when(F.col("mood") == "positive", "negative").otherwise("positive").alias("mood")
    open_ = staging.written(told(stored.filter(~F.coalesce("archived", F.lit(False)) & (F.col("type") != "reflection")), "other"), "stored-told")
    met = by_name(kinds, "kind").select("chat_id", opposite, "who", "kind").join(by_name(open_, "other", "ord"), ["chat_id", "mood", "who"]).select("kind", "other", F.coalesce("ord", F.lit(-(1 << 62))).alias("ord")).distinct()
    lists = staging.written(ranking.place(met, "kind", "ord", ["other"], 1000).select("kind", "other", "place", F.floor(F.col("place") / LIST).alias("part")), "lists")
    own = fresh.join(kinds, kind).select("chat_id", "kind", "id")
    # a memory that stands in its own list, as its stored form is of another mind, is left out, and those behind it move up
    own = own.join(lists.select("kind", F.col("other").alias("id"), F.col("place").alias("self")), ["kind", "id"], "left")
    own = staging.written(own.join(lists.groupBy("kind").agg(F.max("part").alias("parts"), F.count(F.lit(1)).alias("n")), "kind"), "new-kinds")
    pairs = own.agg(F.sum("n")).first()[0] or 0
    tasks = int(min(10_000, max(own.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS)))
    asked = own.select("chat_id", "kind", "id", "self", F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("part")).repartition(tasks, "kind", "part")
    found = asked.join(lists.repartition(tasks, "kind", "part").hint("shuffle_merge"), ["kind", "part"]).filter("id <> other")
    place = F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0)
    return found.select("chat_id", "id", "other", place.cast("int").alias("place"))


def similar_to_new(new: DataFrame, stored: DataFrame, at_least: float = DEFAULTS.contradiction_similarity, n: int = 10) -> DataFrame:
    """chat_id, id, other, similarity, place: the ``n`` stored events most like each new memory by their vectors, among those that share a character with it.

    A new memory that names nobody is compared with all events of its chat that name somebody.
    """
    from .. import staging
    from ..functions import vector
    from . import ranking
    from .near import near

    def named(df: DataFrame, name: str, v: str) -> DataFrame:
        who = F.array_distinct(F.transform(F.coalesce("characters", F.array().cast("array<string>")), lambda c: F.lower(c)))
        usable = df.filter(F.col("embedding").isNotNull() & (vector.norm(F.col("embedding")) > 0))
        return usable.select("chat_id", F.col("id").alias(name), F.col("embedding").alias(v), vector.norm(F.col("embedding")).alias(f"{v}_norm"), who.alias("names"))

    def by_name(df: DataFrame, name: str, v: str, to: str) -> DataFrame:
        return df.select("chat_id", F.explode("names").alias("who"), F.col(name).alias(to), F.col(v).alias(v))

    a = named(new, "id", "va")
    b = named(stored.filter(~F.coalesce("archived", F.lit(False)) & (F.col("type") != "reflection")), "other", "vb").filter(F.size("names") > 0)
    # one more than asked for, as a memory may be found for itself
    met = near(by_name(a, "id", "va", "l"), by_name(b, "other", "vb", "r"), ["chat_id", "who"], at_least, n + 1).select("chat_id", "l", "r")
    anyone = a.filter(F.size("names") == 0)
    if not anyone.isEmpty():
        met = met.unionByName(near(anyone.select("chat_id", F.col("id").alias("l"), "va"), b.select("chat_id", F.col("other").alias("r"), "vb"), ["chat_id"], at_least, n + 1))
    met = staging.written(met.distinct().toDF("chat_id", "id", "other"), "near-pairs")
    pairs = met.filter("id <> other").join(a.drop("names"), ["chat_id", "id"]).join(b.drop("names"), ["chat_id", "other"])
    pairs = pairs.filter(F.size("va") == F.size("vb")).select("chat_id", "id", "other", (vector.dot(F.col("va"), F.col("vb")) / (F.col("va_norm") * F.col("vb_norm"))).alias("similarity"))
    pairs = pairs.filter(F.col("similarity") >= at_least)
    return ranking.top_n(pairs, ["chat_id", "id"], [F.desc("similarity"), F.col("other")], n, "place")


def in_turns(checks: DataFrame, budget: int, per_event: int = 3) -> DataFrame:
    """The checks (chat_id, ord, id, other, place) that a batch's budget pays for: the first of every event, then the second of every event, and so on."""
    from . import ranking

    return ranking.top_n(checks.filter(F.col("place") <= per_event), ["chat_id"], [F.col("place"), F.col("ord"), F.col("id")], budget, "turn")


def full_scan(memories: DataFrame, analysed: DataFrame, limit: int) -> DataFrame:
    """The suspicious pairs of all memories that haven't been analysed (chat_id, pair_key) yet, ``limit`` of each chat at most, opposite moods first."""
    from . import ranking

    pairs = suspicious_pairs(memories.filter(~F.coalesce("archived", F.lit(False))))
    told = memories.select("chat_id", "id", "summary")
    for side in ("older", "newer"):
        pairs = pairs.join(told.select("chat_id", F.col("id").alias(side), F.col("summary").alias(f"{side}_summary")), ["chat_id", side])
    key = pair_key(F.col("older"), F.col("older_summary"), F.col("newer"), F.col("newer_summary"))
    pairs = pairs.withColumn("pair_key", key).dropDuplicates(["chat_id", "pair_key"]).join(analysed.select("chat_id", "pair_key"), ["chat_id", "pair_key"], "left_anti")
    order = [F.when(F.col("reason") == "opposite", 0).otherwise(1), F.desc("newer"), F.desc("older")]
    return ranking.top_n(pairs.drop("older_summary", "newer_summary"), ["chat_id"], order, limit)


def pair_key(id1: Column, summary1: Column, id2: Column, summary2: Column) -> Column:
    """Key of an analysed pair; it changes when a summary does."""
    one, two = (F.concat_ws(":", i.cast("string"), F.xxhash64(s).cast("string")) for i, s in ((id1, summary1), (id2, summary2)))
    return F.concat_ws("|", F.least(one, two), F.greatest(one, two))


def remember_pairs(cache: DataFrame, new: DataFrame, limit: int = DEFAULTS.analysed_pairs) -> DataFrame:
    """The analysed pairs (chat_id, pair_key, ord) of both, of which the newest ``limit`` of a chat stay."""
    from . import ranking

    all_ = cache.unionByName(new).groupBy("chat_id", "pair_key").agg(F.max("ord").alias("ord"))
    return ranking.top_n(all_, ["chat_id"], [F.desc("ord"), F.col("pair_key")], limit).drop("rank")
