"""Near-duplicate groups by MinHash.

1. A text's set of word shingles gives ``bands * ROWS`` universal hash minima.
   Documents with equal sets form a class, which its smallest doc_id stands for.
2. Minima are banded; representatives that share a band are candidates. There are as many bands as it takes
   that a pair at the threshold misses all with a chance of 1e-6 at most: 19 at 0.85, 27 at 0.8.
3. A shingle that no other candidate has can't be shared, which bounds how much
   a candidate can share at all; those that can't reach the threshold with the smallest
   set of a bucket leave it. The bound is exact, nothing else is dropped.
4. In each bucket the member with the fewest such shingles is the pivot. Pairs
   with the pivot are verified by signature and then on full sets; links give
   components by alternating large-star and small-star.
5. Only pairs of a bucket that neither contain its pivot nor lie in one component could still
   matter. Buckets of over LARGE members that hold such pairs take another pivot, ROUNDS times at most; what is still
   undecided then, and smaller buckets, is compared in blocks of members.

Texts are read where they lie: shingle sets are made only of candidates, which the scan picks by their ids.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec
from .components import connected_components

WIDTH, ROWS = 5, 4
#: A pair is verified on full sets if its signatures agree this much less than the threshold: over six standard deviations at 0.8 and 0.85.
SLACK = 0.25
#: The greatest chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Documents of which a worker holds the sets at a time.
SLICE = 512
#: Members of a block when a bucket is compared in blocks.
BLOCK = 128
#: Undecided members from which on a bucket takes further pivots before that, and how many.
LARGE, ROUNDS = 4096, 8


def bands_for(percent: int) -> int:
    """The fewest bands by which a pair at the threshold is missed with a chance of MISS at most."""
    hit = (percent / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log1p(-hit)) if hit < 1 else 1


def _universal(count: int, seed: int = 4711) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 64, (count, 1), dtype=np.uint64, endpoint=False) | np.uint64(1)
    return a, rng.integers(0, 1 << 64, (count, 1), dtype=np.uint64, endpoint=False)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash (a x + b) mod 2^64 over the items; the upper 32 bits of it."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):
        hashed = a * items[None, at : at + 256]
        hashed += b
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketcher(width: int, bands: int):
    def sketch(parts):
        a, b = _universal(bands * ROWS)
        for whole in parts:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                n, key, sig = [], [], []
                for items in textvec.shingle_sets(part.column(1), width):
                    n.append(len(items))
                    key.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    sig.append(signature(items, a, b).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "key", "sig"])

    return sketch


def _setter(width: int):
    def sets(parts):
        for whole in parts:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                found = [x.view(np.int64) for x in textvec.shingle_sets(part.column(1), width)]
                n = np.array([len(x) for x in found], np.int64)
                values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], ["rep", "n", "items"])

    return sets


def _agreeing(threshold: float, bands: int):
    def agreeing(parts):
        for part in parts:
            x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint32).reshape(-1, bands * ROWS) for i in (3, 4))
            keep = (x == y).mean(axis=1) >= threshold
            yield part.select([0, 1, 2]).filter(pa.array(keep))

    return agreeing


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sets, each sorted as unsigned numbers."""
    x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _linked(percent: int):
    def linked(parts):
        for part in parts:
            x, y = part.column(2), part.column(3)
            keep = []
            for i in range(part.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = _shared(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return linked


def _block_links(percent: int):
    def links(pdf):
        import pandas as pd

        one, two = pdf[pdf["block"] == pdf["i"]], pdf[pdf["block"] == pdf["j"]]
        n1, n2 = one["n"].to_numpy()[:, None], two["n"].to_numpy()[None, :]
        most = np.minimum(one["able"].to_numpy()[:, None], two["able"].to_numpy()[None, :])
        maybe = (100 + percent) * most >= percent * (n1 + n2)
        maybe &= one["c"].to_numpy()[:, None] != two["c"].to_numpy()[None, :]
        if len(one) and len(two) and one["block"].iloc[0] == two["block"].iloc[0]:
            maybe = np.triu(maybe, 1)
        sets1, sets2 = one["items"].tolist(), two["items"].tolist()
        found = []
        for p, q in zip(*np.nonzero(maybe)):
            both = _shared(sets1[p], sets2[q])
            if 100 * both >= percent * (len(sets1[p]) + len(sets2[q]) - both):
                found.append((one["rep"].iloc[p], two["rep"].iloc[q]))
        return pd.DataFrame(found, columns=["a", "b"])

    return links


def _verified(pairs: DataFrame, sigs: DataFrame, items: DataFrame, percent: int, n_bands: int) -> DataFrame:
    """The links (a, b) among pairs (pivot, rep), a written table: by signature first, then on full sets.

    A pivot may be in a large share of the pairs, so signatures and sets are met over salted keys.
    """
    kind = dict(pairs.dtypes)["rep"]
    pairs = common.materialize(pairs, "pairs")
    counts = common.materialize(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")), "pivot-counts")
    counted = common.join_by_count(pairs, counts, "pivot", "c", pairs.count()).select("pivot", "rep", "c")
    both = common.salted_join(counted.join(sigs.hint("merge"), "rep"), sigs.toDF("pivot", "sig2"), "pivot", counts, "rep")
    agreeing = _agreeing(percent / 100 - SLACK, n_bands)
    schema = f"pivot {kind}, rep {kind}, c long"
    counted = common.materialize(common.map_arrow(both.select("pivot", "rep", "c", "sig", "sig2"), agreeing, schema), "agreeing")
    both = common.salted_join(counted.join(items.hint("merge"), "rep"), items.toDF("pivot", "items2"), "pivot", counts, "rep")
    both = both.select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "items", "items2")
    return common.materialize(common.map_arrow(both, _linked(percent), f"a {kind}, b {kind}"), "links")


def _undecided(members: DataFrame, name: str) -> DataFrame:
    """band, rep, n, alone, able, c, size, pivot: the members of buckets that still hold more than one c; members with equal c are linked.

    ``pivot`` is a member that hasn't been one: the pivots so far aren't among ``members``.
    """
    members = common.materialize(members, name)
    per = members.groupBy("band").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"), F.min(F.struct("alone", "rep"))["rep"].alias("pivot")
    )
    split = common.materialize(per.filter("lo <> hi").select("band", "size", "pivot"), f"{name}-split")
    return common.materialize(common.join_by_count(members, split, "band", "size", members.count()), f"{name}-left")


def _more_pivots(open_: DataFrame, sigs: DataFrame, items: DataFrame, percent: int, n_bands: int) -> tuple[DataFrame, DataFrame | None]:
    """(what is undecided, links) after further pivots of large buckets. What a pivot links takes its c, as it is then linked with all of that c."""
    links = None
    for i in range(ROUNDS):
        large = open_.filter(f"size > {LARGE}")
        rows = large.count()
        if not rows:
            break
        own = large.filter("rep = pivot").groupBy("band").agg(F.min("c").alias("pc"), F.min("size").alias("in_bucket"))
        large = common.materialize(common.join_by_count(large, common.materialize(own, "own"), "band", "in_bucket", rows), "large")
        more = _verified(large.filter("rep <> pivot and c <> pc").select("pivot", "rep").distinct(), sigs, items, percent, n_bands)
        links = more if links is None else links.unionByName(more)
        found = more.distinct().select(F.col("a").alias("pivot"), F.col("b").alias("rep"), F.lit(True).alias("linked"))
        # a pair is in as many buckets at most as there are bands, so nothing is hot here
        large = large.filter("rep <> pivot").join(found, ["pivot", "rep"], "left").withColumn("c", F.expr("if(linked, pc, c)"))
        rest = open_.filter(f"size <= {LARGE}").drop("size", "pivot").unionByName(large.select("band", "rep", "n", "alone", "able", "c"))
        open_ = _undecided(rest, f"open{i}")
    return open_, links


def near_duplicate_components(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Words are stretches without ASCII white space, A-Z lower-cased. Documents are
    linked when 100 * common shingles >= percent * all shingles of the two, and a
    component is named by its smallest doc_id. Null or empty texts have no
    shingles and are linked with nothing. Null doc_ids are linked with nothing: their component is null and
    they are kept. Rows that repeat a doc_id count as one node. Very long texts are taken whole. Other columns are ignored.
    """
    kind, n_bands = dict(docs.dtypes)["doc_id"], bands_for(percent)
    docs = docs.select("doc_id", "text")
    sketches = common.materialize(
        common.map_arrow(docs, _sketcher(width, n_bands), f"doc_id {kind}, n long, key binary, sig binary"), "minhash"
    )
    usable = sketches.filter("n > 0 and doc_id is not null")
    classes = common.materialize(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")

    # a class of one stands for itself; of the others, which a filter picks, one row each is made
    several = classes.filter("c > 1").select("key")
    marked = common.BitFilter(several, ["key"], several.count(), "several-filter").mark(usable, F.col("key"))
    several = marked.filter("__maybe").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    standing = marked.filter("not __maybe").select("doc_id", "n", "sig").unionByName(several.select("doc_id", "n", "sig"))
    bands = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(n_bands)]))
    banded = common.materialize(standing.select(F.col("doc_id").alias("rep"), "n", bands.alias("band")), "bands")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band")
    members = common.materialize(common.keep_keys(banded, common.materialize(shared, "shared-bands"), "band", "band-filter"), "members")

    candidates = common.materialize(members.select("rep").distinct(), "candidates")
    picked = common.keep_keys(docs, candidates, "doc_id", "candidate-filter")
    sets = common.materialize(common.map_arrow(picked, _setter(width), f"rep {kind}, n long, items array<long>"), "sets")
    items = sets.select("rep", "items")
    sigs = common.keep_keys(usable.select(F.col("doc_id").alias("rep"), "sig"), candidates, "rep", "candidate-filter")
    sigs = common.materialize(sigs, "signatures")

    alone = sets.select("rep", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep"))
    alone = alone.filter("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    members = members.join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).withColumn("able", F.expr("n - alone"))
    members = common.materialize(members, "able")
    smallest = common.materialize(members.groupBy("band").agg(F.min("n").alias("min_n"), F.count(F.lit(1)).alias("c")), "smallest")
    members = common.join_by_count(members, smallest, "band", "c", members.count()).drop("c")
    members = common.materialize(members.filter(f"{100 + percent} * able >= {percent} * (n + min_n)").drop("min_n"), "able-members")
    pivots = members.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("alone", "rep"))["rep"].alias("pivot"))
    pivots = common.materialize(pivots.filter("c > 1"), "pivots")
    members = common.materialize(common.join_by_count(members, pivots, "band", "c", members.count()), "buckets")

    edges = _verified(members.filter("rep <> pivot").select("pivot", "rep").distinct(), sigs, items, percent, n_bands)
    joined = connected_components(edges)

    # what no pivot has decided
    open_ = members.filter("rep <> pivot and c > 2").drop("c").join(joined.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left")
    open_ = _undecided(open_.select("band", "rep", "n", "alone", "able", F.coalesce("c", "rep").alias("c")), "open")
    open_, further = _more_pivots(open_, sigs, items, percent, n_bands)
    if not open_.isEmpty():
        count = f"cast(ceil(size / {BLOCK}) as int)"
        open_ = open_.withColumn("block", F.expr(f"cast(pmod(xxhash64(rep), {count}) as int)"))
        open_ = open_.withColumn("other", F.explode(F.expr(f"sequence(0, {count} - 1)")))
        open_ = open_.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "size")
        blocks = open_.join(items.hint("merge"), "rep").groupBy("band", "i", "j")
        more = common.materialize(blocks.applyInPandas(_block_links(percent), f"a {kind}, b {kind}").distinct(), "more-links")
        further = more if further is None else further.unionByName(more)
    if further is not None and not further.isEmpty():
        joined = connected_components(edges.unionByName(further))

    # classes without a link keep their representative; only linked and repeated sets have anything to be told
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").filter("c > 1 or component is not null")
    named = common.materialize(named.select("key", F.coalesce("component", "rep").alias("c"), F.col("c").alias("copies")), "named")
    marked = common.BitFilter(named.select("key"), ["key"], named.count(), "named-filter").mark(sketches.drop("sig"), F.col("key"))
    met = common.join_by_count(marked.filter("__maybe").drop("__maybe"), named, "key", "copies", sketches.count(), "left")
    none = marked.filter("not __maybe").drop("__maybe").withColumns({"c": F.lit(None).cast(kind), "copies": F.lit(None).cast("long")})
    met = met.unionByName(none)
    return met.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Each row is a node of its own: where doc_ids are null or repeated, rows are numbered in their order, nulls last, and numbers stand for doc_ids.
    """
    if common.ids_are_unique(docs):
        gone = near_duplicate_components(docs, percent).filter(~F.col("kept")).select("doc_id")
        return common.drop_keys(docs, common.materialize(gone, "near-decided"), "doc_id", "decided-filter")
    # the text's hash and the row's place split the rows of one doc_id over tasks
    docs = docs.withColumn("__row", F.monotonically_increasing_id())
    docs = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"), "__row").withColumn("__row", F.monotonically_increasing_id())
    docs = common.materialize(docs, "numbered")
    gone = near_duplicate_components(docs.select(F.col("__row").alias("doc_id"), "text"), percent).filter(~F.col("kept")).select("doc_id")
    return common.drop_keys(docs, common.materialize(gone, "near-decided"), "__row", "decided-filter").drop("__row")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(common.read_table(spark, sf_dir, "documents"))
