"""BM25 top rows with block maxima: postings of frequent terms are read only where they can still matter.

The index has a row for each posting with its impact, that is its part of a score but for the query's multiplicity, and a header for each term and block
of neighbouring ids with the greatest impact there. Rare terms are read whole. What frequent terms can add to a memory is bounded by the headers of its
block, so blocks in which no memory can reach the k-th score are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import staging
from ..config import DEFAULTS, Settings
from . import lexical, ranking

#: Ids of a block, and the share of a chat's memories from which on a term is frequent there.
WIDTH, OFTEN = 16, 1 / 8
KEY = ["query_id", "chat_id"]
#: Added to bounds, which are sums in another order than scores.
SLACK = 1e-9


@dataclass
class Blocks:
    """``postings`` (chat_id, term, block, id, impact) and ``headers`` (chat_id, term, block, top, n), ``idf`` and ``corpus`` as in ``lexical``; all written."""

    postings: DataFrame
    headers: DataFrame
    idf: DataFrame
    corpus: DataFrame


def index(told: DataFrame, width: int = WIDTH, settings: Settings = DEFAULTS, terms: DataFrame | None = None) -> Blocks:
    """The index of tokenized memories (``lexical.tokenized``, written) with whole numbers as ids; of ``terms`` (term) only where they are given, for queries that have no others.

    A term's postings are dealt by its hash and block, so that no frequent term is one task, and are sorted within each file, so that a scan skips other terms.
    """
    corpus = staging.written(lexical.corpus_size(told), "block-corpus")
    posted = staging.written(lexical.postings(told, terms), "block-tf")
    idf = staging.written(lexical.idf_table(posted, corpus), "block-idf")
    k1, b = settings.k1, settings.b
    rows = posted.join(staging.small(idf.select("chat_id", "term", "idf")), ["chat_id", "term"]).join(F.broadcast(corpus.select("chat_id", "avg_dl")) if corpus.count() <= 100_000 else corpus, "chat_id")
    impact = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    rows = rows.select("chat_id", "term", F.floor(F.col("id") / width).alias("block"), "id", impact.alias("impact"))
    postings = staging.written(rows.repartition("term", "block").sortWithinPartitions("term", "chat_id", "block"), "block-postings")
    headers = postings.groupBy("chat_id", "term", "block").agg(F.max("impact").alias("top"), F.count(F.lit(1)).alias("n"))
    return Blocks(postings, staging.written(headers, "block-headers"), idf, corpus)


def _scored(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, chat_id, block, id, part: what asked terms (query_id, chat_id, term, multiplicity and maybe block) add to each memory."""
    on = [c for c in ("chat_id", "term", "block") if c in asked.columns]
    met = asked.join(postings, on)
    return met.groupBy(*KEY, "block", "id").agg(F.sum(F.col("multiplicity") * F.col("impact")).alias("part"))


def top(terms: DataFrame, blocks: Blocks, k: int, often: float = OFTEN) -> tuple[DataFrame, DataFrame]:
    """(query_id, chat_id, id, bm25, rank of the k best memories; read): as ``lexical.bm25`` cut to k, ties by id.

    ``terms`` has query_id, term, count. ``read`` (query_id, chat_id, term, block, n) names the blocks of frequent terms that were read.
    """
    weighted = staging.written(lexical.weigh_terms(terms, blocks.idf, blocks.corpus).select(*KEY, "term", "multiplicity"), "block-terms")
    spread = blocks.headers.groupBy("chat_id", "term").agg(F.sum("n").alias("df")).join(blocks.corpus.select("chat_id", "n_docs"), "chat_id")
    frequent = spread.filter(F.col("df") > F.greatest(F.lit(float(k)), F.col("n_docs") * often)).select("chat_id", "term")
    many = staging.small(staging.written(weighted.join(frequent, ["chat_id", "term"], "left_semi"), "block-many"))
    few = staging.small(staging.written(weighted.join(frequent, ["chat_id", "term"], "left_anti"), "block-few"))
    partial = staging.written(_scored(few, blocks.postings), "block-partial")
    ask = staging.written(many.join(blocks.headers, ["chat_id", "term"]), "block-ask")  # every header of a frequent term that a query has
    rest = staging.written(ask.groupBy(*KEY, "block").agg(F.sum(F.col("multiplicity") * F.col("top")).alias("rest")), "block-rest")

    # the blocks of the best memories by rare terms, and the best by what headers allow, give a first k-th score
    best = partial.groupBy(*KEY, "block").agg(F.max("part").alias("most"))
    bound = rest.join(best, [*KEY, "block"], "full").select(*KEY, "block", (F.coalesce("most", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0)) + SLACK).alias("bound"))
    bound = staging.written(bound, "block-bounds")
    first = ranking.top_n(partial, KEY, [F.desc("part"), F.col("id")], k).select(*KEY, "block").unionByName(ranking.top_n(bound, KEY, [F.desc("bound"), F.col("block")], 1).select(*KEY, "block")).distinct()
    first = staging.written(first, "block-first")

    def whole(chosen: DataFrame) -> DataFrame:
        """The scores of all memories of chosen blocks."""
        more = _scored(ask.join(chosen, [*KEY, "block"], "left_semi").select(*KEY, "term", "multiplicity", "block"), blocks.postings)
        rows = more.unionByName(partial.join(chosen, [*KEY, "block"], "left_semi"))
        return rows.groupBy(*KEY, "id").agg(F.sum("part").alias("bm25"))

    done = staging.written(whole(first), "block-scored")
    kth = ranking.top_n(done, KEY, [F.desc("bm25"), F.col("id")], k).groupBy(*KEY).agg(F.min("bm25").alias("kth"), F.count(F.lit(1)).alias("got"))
    left = bound.join(first, [*KEY, "block"], "left_anti").join(kth, KEY, "left").filter((F.coalesce("got", F.lit(0)) < k) | (F.col("bound") >= F.col("kth")))
    second = staging.written(left.select(*KEY, "block"), "block-second")
    scores = done.unionByName(whole(second)).withColumn("bm25", F.round("bm25", 9))
    read = ask.join(first.unionByName(second), [*KEY, "block"], "left_semi").select(*KEY, "term", "block", "n")
    return ranking.top_n(scores, KEY, [F.desc("bm25"), F.col("id")], k), read


def frequent_postings(blocks: Blocks, terms: DataFrame, k: int, often: float = OFTEN) -> int:
    """How many postings the frequent terms of the queries have in all: what would be read without bounds."""
    weighted = lexical.weigh_terms(terms, blocks.idf, blocks.corpus).select(*KEY, "term")
    spread = blocks.headers.groupBy("chat_id", "term").agg(F.sum("n").alias("df")).join(blocks.corpus.select("chat_id", "n_docs"), "chat_id")
    frequent = spread.filter(F.col("df") > F.greatest(F.lit(float(k)), F.col("n_docs") * often))
    return weighted.join(frequent, ["chat_id", "term"]).agg(F.sum("df")).first()[0] or 0
