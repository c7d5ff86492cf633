"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many words. Slot ``n`` looks up the
golden-ratio point ``n * g mod N`` (``g`` is the integer nearest to ``N / phi`` that
shares no factor with ``N``, so the points are a permutation) in the cumulative
slot counts of the sources. The k-th slot of a source takes the k-th block of
that source's shuffled word stream, which repeats from its start when it ends.
All steps are DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words in a slot.
BLOCK = 4096
#: Rows of a hash range that is ordered by one task.
BUCKET_ROWS = 1024
#: Points of a source that are laid out together, and points of a task.
STRETCH, TASK_POINTS = 4096, 1 << 20


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, columns ``more``, size in words; null text has 0."""
    return docs.select("doc_id", "source", *more, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame, cap: int = 3) -> DataFrame:
    """One row for each source: source, source_size, weight, target.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3... A target is
    the source's share by weight of all words, at most ``cap`` times its size;
    what is cut off goes to the others by weight, again and again. That ends
    where target = least(cap * size, level * weight); sorted by cap * size / weight
    the cut sources come first, which gives the level in one pass.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    per = per.withColumn("limit", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    cut, cut_weight = F.coalesce(F.sum("limit").over(by_ratio), F.lit(0)), F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    per = per.withColumn("level", (total - cut) / (weights - cut_weight))
    # the first source that its level doesn't cut sets the level of all that follow
    place = F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()))
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("place"), F.col("level").alias("free")))
    per = per.withColumn("place", place).withColumn("free", F.min(free).over(everything)["free"])
    return per.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("limit").cast("double"), F.coalesce(F.col("free") * F.col("weight"), F.col("limit").cast("double"))).alias("target"),
    )


def _step(n: int) -> int:
    """The integer nearest to n / phi that shares no factor with n."""
    g = max(1, round(n / ((1 + 5**0.5) / 2)))
    for d in range(n + 1):
        for x in (g - d, g + d):
            if 0 < x and math.gcd(x, n) == 1:
                return x
    return 1


def plan(sized: DataFrame, cap: int = 3, block: int = BLOCK) -> DataFrame:
    """One row for each source, a written table: source_no, source, source_size, target, words, lo, hi.

    ``words`` is the target rounded down. Blocks of the source hold the points lo to hi - 1 of all points.
    """
    per = source_targets(sized, cap).withColumn("words", F.floor("target").cast("long"))
    per = per.withColumn("slots", F.expr(f"(words + {block - 1}) div {block}"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(order) - 1).withColumn("hi", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.select("source_no", "source", "source_size", "target", "words", (F.col("hi") - F.col("slots")).alias("lo"), "hi")
    return common.materialize(per, "mix-plan")


def schedule(sources: DataFrame) -> DataFrame:
    """slot, source_no, rank: which block of which source each slot of the mix takes.

    ``sources`` has source_no, lo and hi. Slot n has point n * g mod N, so point p is that of slot p / g mod N: each
    source's points are laid out in stretches and turned into slots, with no search for the source of a point.
    """
    n = sources.agg(F.max("hi")).first()[0] or 0
    back = pow(_step(n), -1, n) if n > 1 else 1
    spans = sources.filter("lo < hi").select("source_no", "lo", "hi", F.explode(F.expr(f"sequence(lo div {STRETCH}, (hi - 1) div {STRETCH})")).alias("s"))
    spans = spans.repartition(max(1, -(-n // TASK_POINTS)), "source_no", "s")
    points = spans.select("source_no", F.explode(F.expr(f"sequence(greatest(lo, s * {STRETCH}), least(hi, (s + 1) * {STRETCH}) - 1)")).alias("point"))
    slots = points.select("source_no", F.expr(f"cast(cast(point as decimal(38,0)) * {back} % {max(1, n)} as long)").alias("slot"))
    # rank of a slot among its source's: count by stretches of slots, then within a stretch
    slots = slots.withColumn("stretch", F.expr("slot div 1024"))
    counts = slots.groupBy("source_no", "stretch").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("far", F.expr("stretch div 1024"))
    near = Window.partitionBy("source_no", "far").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = counts.groupBy("source_no", "far").agg(F.sum("c").alias("c"))
    far_w = Window.partitionBy("source_no").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("source_no", "far", F.coalesce(F.sum("c").over(far_w), F.lit(0)).alias("off_far"))
    before = counts.withColumn("off", F.coalesce(F.sum("c").over(near), F.lit(0))).join(far, ["source_no", "far"])
    within = Window.partitionBy("source_no", "stretch").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(within) - 1)
    return ranked.join(before.select("source_no", "stretch", (F.col("off") + F.col("off_far")).alias("o")), ["source_no", "stretch"]).select(
        "slot", "source_no", (F.col("r") + F.col("o")).alias("rank")
    )


def _order_key(seed: int):
    """Documents of a source come in the order of this key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _placed(docs: DataFrame, seed: int, cap: int, block: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """(documents with the place ``start`` of their first word in their source's stream and columns ``more``, plan), both written."""
    key = _order_key(seed)
    sized = sizes(docs, *more).withColumn("key", F.conv(F.substring(key, 1, 8), 16, 10).cast("long")).withColumn("tie", key)
    sized = common.materialize(sized, "mix-sizes")
    sources = plan(sized, cap, block)
    table = common.small(sources.select("source_no", F.col("source").alias("__s"), "source_size", "target", "words"))
    placed = sized.join(table, common.same(F.col("source"), F.col("__s"))).drop("__s").withColumn("tie2", F.struct("tie", "doc_id", *more))
    placed = common.prefix_sum(placed, "source_no", ["key", "tie2"], "size", "start", BUCKET_ROWS, sized.count())
    return common.materialize(placed.drop("tie2"), "mix-placed"), sources


def _stretches(placed: DataFrame, cap: int) -> DataFrame:
    """Placed documents with ``a`` and ``b``, a row for each stretch of the repeated stream that the mix takes of them."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    stretch = placed.filter("size > 0").select("*", rounds.alias("round"))
    return stretch.withColumn("a", F.expr("round * source_size + start")).withColumn("b", F.expr("least(a + size, words)")).filter("a < b")


def mix(docs: DataFrame, seed: int = 17, cap: int = 3, block: int = BLOCK):
    """(documents, pieces) of the mix.

    documents: doc_id, source, size, source_size, target, taken, first_slot, last_slot, n_pieces. pieces: slot, doc_id,
    from_word, to_word: the words that each slot takes of a document, which are also what ``taken`` sums up.
    The order of a source's documents is that of md5(seed:doc_id), then doc_id, so reruns agree.
    Null text has size 0 and is never taken; a null source is a source of its own.
    Rows that repeat a doc_id are separate documents of its source, and each gets its own words.
    Very long texts span several blocks. Other columns are ignored, and an empty table gives none.
    """
    placed, sources = _placed(docs, seed, cap, block)
    # a document's stretches of the repeated stream, cut where blocks end
    stretch = _stretches(placed, cap)
    blocks = F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}")))
    pieces = stretch.select("*", blocks.alias("rank"))
    pieces = pieces.select(
        "source_no", "rank", "doc_id", "start",
        (F.greatest("a", F.col("rank") * block) - F.col("a")).alias("from_word"),
        (F.least("b", (F.col("rank") + 1) * block) - F.col("a")).alias("to_word"),
    )
    pieces = pieces.join(schedule(sources), ["source_no", "rank"])
    t = pieces.groupBy(F.col("source_no").alias("n2"), F.col("doc_id").alias("d2"), F.col("start").alias("s2")).agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.count(F.lit(1)).alias("n_pieces"),
    )
    on = (F.col("source_no") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("start") == F.col("s2")) & (F.col("size") > 0)
    documents = placed.join(t, on, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_slot", "last_slot", F.coalesce("n_pieces", F.lit(0)).cast("long").alias("n_pieces"),
    )
    return documents, pieces.select("slot", "doc_id", "from_word", "to_word")


def apply_mix(docs: DataFrame, seed: int = 17, cap: int = 3, block: int = BLOCK) -> DataFrame:
    """The documents of the mix with all their columns: whole, as often as a block of the schedule takes their first word, in the order of the schedule's slots.

    So a source's words miss its target by less than one document, and any part of the output mixes the sources nearly as the whole does. Within a slot documents
    come as in their source's stream. Documents with no words are neither weighed nor dropped: they stay once, before all others. Where ids are missing or
    repeated, rows are numbered first. Slots are joined by document, so a text is shuffled twice: to its slots and into their order.
    """
    row, names = "__mix_row", [F.col(f"`{c}`") for c in docs.columns]
    if common.ids_are_unique(docs):
        docs = docs.withColumn(row, F.col("doc_id"))
    else:
        docs = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    placed, sources = _placed(docs.select("doc_id", "text", "source", row), seed, cap, block, row)
    firsts = _stretches(placed, cap).select(row, "source_no", "a", F.expr(f"a div {block}").alias("rank")).join(schedule(sources), ["source_no", "rank"])
    none = F.lit(None).cast("long")
    takes = firsts.select(row, F.col("slot").alias("__mix_slot"), F.col("a").alias("__mix_at"))
    takes = takes.unionByName(placed.filter("size = 0").select(row, none.alias("__mix_slot"), none.alias("__mix_at")))
    takes = common.materialize(takes, "mix-takes")
    return docs.join(takes, row).orderBy(F.col("__mix_slot").asc_nulls_first(), "__mix_at", row).select(*names)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return documents.drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 3 AS cap,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER p, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
  FROM s
  WINDOW p AS (ORDER BY source_size * 3 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce(first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (
           ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, cap::DOUBLE)) AS target
  FROM c
), p AS (
  SELECT doc_id, d.source, size, f.source_size, f.target, floor(f.target)::BIGINT AS words,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
), w AS (
  SELECT source, (floor(target)::BIGINT + 4095) // 4096 AS slots, sum((floor(target)::BIGINT + 4095) // 4096) OVER (ORDER BY source NULLS LAST) AS hi FROM f
), n AS (
  SELECT max(hi)::BIGINT AS n FROM w
), g AS (
  SELECT n, x AS g FROM n, range(1, (SELECT 2 * n + 2 FROM n)) t(x) WHERE gcd(x, n) = 1
  ORDER BY abs(x - greatest(1, round(n / ((1 + sqrt(5)) / 2)))), x LIMIT 1
), slot AS (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT t.slot, t.slot * g % n AS point FROM g, range(0, (SELECT n FROM n)) t(slot)) JOIN w ON point >= hi - slots AND point < hi
), stretch AS (
  SELECT doc_id, source, start, r * source_size + start AS a, least(r * source_size + start + size, words) AS b FROM p, range(0, 3) t(r) WHERE size > 0
), piece AS (
  SELECT doc_id, source, start, a, b, unnest(range(a // 4096, (b - 1) // 4096 + 1)) AS rank FROM stretch WHERE a < b
), met AS (
  SELECT doc_id, p.source, start, sum(least(b, (p.rank + 1) * 4096) - greatest(a, p.rank * 4096))::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot,
         count(*) AS n_pieces
  FROM piece p JOIN slot ON slot.source IS NOT DISTINCT FROM p.source AND slot.rank = p.rank GROUP BY ALL
)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, last_slot, coalesce(n_pieces, 0) AS n_pieces
FROM p LEFT JOIN met ON p.size > 0 AND met.doc_id IS NOT DISTINCT FROM p.doc_id AND met.source IS NOT DISTINCT FROM p.source AND met.start = p.start
"""
