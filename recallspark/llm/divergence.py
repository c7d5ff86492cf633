"""Audit of how far the sources of a language diverge in their words.

A table of 256 bytes lowers A-Z and turns every separator into a blank, so ``bytes.translate`` and ``bytes.split`` make a document's terms,
and a Counter of it gives frequencies and, one for each term, document counts. These are added up in a task and shuffled as sparse sums. Only terms that enough
documents of a language have are kept, so everything that follows is about kept terms. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking
from . import common

#: Documents of its language that a kept term is in, at least; ranks of divergent terms that are told.
MIN_DOCS, TOP_TERMS = 30, 50
#: What is added to each count, and the scale of a term's share.
ADDED, SCALE = 5, 1_000_000_000
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Terms of a block at least, and sources of a tile at most, in which sources are compared.
BLOCK_TERMS, TILE = 256, 512

#: Letters A-Z become a-z, all other ASCII bytes but a-z a blank; bytes of other characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _sums(docs_of: dict, counts_of: dict):
    """A batch (lang, term, docs, counts) for each language: what was counted so far, each term with its counts by source."""
    import pyarrow as pa

    for lang, docs in docs_of.items():
        names = list(docs)
        at = {t: i for i, t in enumerate(names)}
        own = [(source, c) for (of, source), c in counts_of.items() if of == lang]
        total = sum(len(c) for _, c in own)
        place = np.fromiter((at[t] for _, c in own for t in c), np.int64, total)
        n = np.fromiter((v for _, c in own for v in c.values()), np.int64, total)
        source = np.repeat(np.arange(len(own), dtype=np.int32), [len(c) for _, c in own])
        order = np.argsort(place, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(names)))]).astype(np.int32)
        told = pa.array([s for s, _ in own], pa.string()).take(pa.array(source[order]))
        counts = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([told, pa.array(n[order])], ["source", "n"]))
        langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(names), np.int32)))
        yield pa.RecordBatch.from_arrays([langs, pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(docs.values()), pa.int64()), counts], ["lang", "term", "docs", "counts"])


def _count(parts):
    import pyarrow as pa

    docs_of, counts_of, held = {}, {}, 0
    for part in parts:
        langs, sources, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            one = Counter(terms(text.as_py()))
            counts = counts_of.setdefault((lang, source), Counter())
            held -= len(counts)
            counts.update(one)
            held += len(counts)
            docs_of.setdefault(lang, Counter()).update(list(one))
            if held > HELD:
                yield from _sums(docs_of, counts_of)
                docs_of, counts_of, held = {}, {}, 0
    yield from _sums(docs_of, counts_of)


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept)), in decimals so that no product overflows; null where nothing is kept."""
    return F.expr(f"1 + (cast({n} + {ADDED} as decimal(19, 0)) * {SCALE}BD) div nullif(cast({total} + {ADDED} * {kept} as decimal(19, 0)), 0BD)")


def _distances(key, cells, groups):
    """The sums of differences of each two sources over the terms of a block that any of its sources has; a source has its share of a count of 0, p0, where it has no cell.

    ``terms`` counts these terms, and ``apart`` is how much two sources differ by each of the kept terms that none here has.
    """
    import pandas as pd

    lang, _, first, second = key
    groups = groups.sort_values("source", ignore_index=True)
    column, _ = pd.factorize(cells["term"])
    width = int(column.max()) + 1 if len(column) else 0
    p0 = groups["p0"].to_numpy(np.int64)
    p = np.repeat(p0[:, None], width, axis=1)
    if width:  # each kept term is in a source at least, but not every block has a term
        p[pd.Index(groups["source"]).get_indexer(cells["source"]), column] = cells["p"].to_numpy(np.int64)
    tile, names = groups["tile"].to_numpy(), groups["source"].to_numpy()
    found = []
    for i in np.flatnonzero(tile == first):
        others = np.flatnonzero(tile == second)
        others = others[others > i] if first == second else others
        sums, apart = np.abs(p[others] - p[i]).sum(axis=1), np.abs(p0[others] - p0[i])
        found.append(pd.DataFrame({"lang": lang, "one": names[i], "other": names[others], "value": sums, "terms": width, "apart": apart, "kept": groups["kept"].iloc[0]}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in ("lang", "one", "other", "value", "terms", "apart", "kept")})


def counted(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(kept terms (lang, term), counts (lang, source, term, n) of kept terms that a group has), both written."""
    told = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    schema = "lang string, term string, docs long, counts array<struct<source: string, n: long>>"
    partial = common.materialize(common.map_arrow(told, _count, schema), "terms")
    kept = partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")
    kept = common.materialize(kept, "terms-kept")
    # terms that are not kept are most of the table; a bounded filter drops nearly all of them before anything is shuffled
    maybe = common.BitFilter(kept, ["lang", "term"], kept.count(), "terms-filter").mark(partial, F.col("lang"), F.col("term")).filter("__maybe")
    each = maybe.select("lang", "term", F.inline("counts")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return kept, common.materialize(each.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "terms-counted")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms from the language as a whole.

    Null text, lang and source count as ''. Texts of any length are counted whole. Groups without terms are compared like others, with the shares of counts of 0; where a language keeps
    no term, all distances are 0. Equal values are ranked by item in the order of UTF-8 bytes. Rows that repeat count again. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kept, cells = counted(docs, min_docs)
    in_lang = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    langs = langs.join(cells.groupBy("lang").agg(F.sum("n").alias("lang_total")), "lang")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = groups.join(sources, "lang").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["kept", "lang_total", "total", "cells"])
    tiles, blocks = F.ceil(F.col("sources") / TILE).cast("int"), F.ceil(F.col("kept") / F.greatest(F.lit(BLOCK_TERMS), 4 * F.least("sources", F.lit(TILE)))).cast("int")
    groups = groups.select(F.struct("lang", "source").alias("g"), "*", tiles.alias("tiles"), blocks.alias("blocks"))
    groups = groups.withColumns({"p0": share("0", "total", "kept"), "tile": F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")})
    groups = common.materialize(groups, "terms-groups")
    told = groups.select("g", "total", "kept", "lang_total", "sources", "tiles", "blocks", "tile", F.col("cells").alias("c"))
    cells = cells.select(F.struct("lang", "source").alias("g"), "term", "n")
    cells = common.join_by_count(cells, told, "g", "c", cells.count()).select("g.lang", "g.source", "term", "kept", "lang_total", "sources", "tiles", "blocks", "tile", share("n", "total", "kept").alias("p"))
    cells = common.materialize(cells, "terms-shares")

    q = share("lang_n", "lang_total", "kept")
    over = cells.join(in_lang, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    best = ranking.top_n(over, ["lang", "source"], [F.desc("value"), F.col("item")], top)

    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    other = [F.least("tile", "__t").alias("first"), F.greatest("tile", "__t").alias("second")]
    dealt = cells.filter("sources > 1").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("__t", F.explode(every)).select("lang", "block", *other, "source", "term", "p")
    each = groups.filter("kept > 0 and sources > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("__t", F.explode(every))
    each = each.select("lang", "block", *other, "source", "tile", "p0", "kept")
    key = ["lang", "block", "first", "second"]
    common.ship_code(spark)
    parts = dealt.groupBy(*key).cogroup(each.groupBy(*key)).applyInPandas(_distances, "lang string, one string, other string, value long, terms long, apart long, kept long")
    sums = parts.groupBy("lang", "one", "other").agg((F.sum("value") + (F.first("kept") - F.sum("terms")) * F.first("apart")).alias("value"))
    none = groups.filter("kept = 0").select("lang", F.col("source").alias("one"))
    zero = none.join(none.withColumnRenamed("one", "other"), "lang").filter("one < other").withColumn("value", F.lit(0).cast("long"))
    half = common.materialize(sums.unionByName(zero), "terms-distances")
    both = half.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "value").unionByName(half.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order))
    shape = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.withColumn("part", F.lit("pair")).select(*shape).unionByName(best.withColumn("part", F.lit("term")).select(*shape))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT g.lang, g.source, count(k.term) AS v FROM grp g LEFT JOIN kept k ON k.lang = g.lang GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v.v) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang AND v.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM cell GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN cell x ON x.lang = a.lang AND x.source = a.source LEFT JOIN cell y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), term AS (SELECT c.lang, c.source, c.term AS item, CAST(p - q AS BIGINT) AS value FROM cell c JOIN whole w ON w.lang = c.lang AND w.term = c.term WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 50
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r
"""
