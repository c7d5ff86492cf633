"""Communities of the entity graph by modularity, as rounds of joins and aggregates."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import staging
from ..config import DEFAULTS, Settings

LOG = logging.getLogger(__name__)
#: Nodes that want to leave or to enter one community in a round; of more, a part is dealt by a hash in each round.
HOT = 200_000
#: Gains below this share of a node's weight are left where they are.
LEAST_GAIN = 1e-9


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """chat_id, modularity of a partition (chat_id, key, community) of undirected edges (chat_id, a, b, weight)."""
    total = edges.groupBy("chat_id").agg(F.sum("weight").alias("m"))
    ends = edges.select("chat_id", F.col("a").alias("key"), "weight").unionByName(edges.select("chat_id", F.col("b").alias("key"), "weight"))
    degree = ends.join(member, ["chat_id", "key"]).groupBy("chat_id", "community").agg(F.sum("weight").alias("k"))
    inner = edges.join(member.select("chat_id", F.col("key").alias("a"), F.col("community").alias("ca")), ["chat_id", "a"])
    inner = inner.join(member.select("chat_id", F.col("key").alias("b"), F.col("community").alias("cb")), ["chat_id", "b"]).filter("ca = cb")
    inner = inner.groupBy("chat_id").agg(F.sum("weight").alias("w"))
    spread = degree.join(total, "chat_id").groupBy("chat_id").agg(F.sum((F.col("k") / (2 * F.col("m"))) ** 2).alias("s"))
    rows = total.join(inner, "chat_id", "left").join(spread, "chat_id", "left")
    return rows.select("chat_id", (F.coalesce("w", F.lit(0.0)) / F.col("m") - F.coalesce("s", F.lit(0.0))).alias("modularity"))


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = edges.select("chat_id", F.col("a").alias("key"), F.col("b").alias("other"), "weight")
    return ends.unionByName(edges.select("chat_id", F.col("b").alias("key"), F.col("a").alias("other"), "weight"))


def _wishes(ends: DataFrame, member: DataFrame, volume: DataFrame, due: DataFrame | None, resolution: float) -> DataFrame:
    """Nodes (of ``due``, or all) that gain by a move: chat_id, key, k, m, source, target, gain.

    Neighbours' communities are summed by (node, community), so a hub is never gathered.
    """
    mine = member
    if due is not None:
        ends, mine = (df.join(due, ["chat_id", "key"], "left_semi") for df in (ends, mine))
    theirs = member.select("chat_id", F.col("key").alias("other"), F.col("community").alias("c"))
    links = ends.filter("key <> other").join(theirs, ["chat_id", "other"]).select("chat_id", "key", "c", "weight", "k", "m", F.lit(False).alias("own"))
    own = mine.select("chat_id", "key", F.col("community").alias("c"), F.lit(0.0).alias("weight"), "k", "m", F.lit(True).alias("own"))
    links = links.unionByName(own).groupBy("chat_id", "key", "c").agg(F.sum("weight").alias("w"), F.first("k").alias("k"), F.first("m").alias("m"), F.max("own").alias("own"))
    rows = links.join(volume.withColumnRenamed("community", "c"), ["chat_id", "c"])
    rest = F.col("volume") - F.when(F.col("own"), F.col("k")).otherwise(0.0)
    rows = rows.withColumn("g", F.round(F.col("w") - resolution * F.col("k") * rest / (2 * F.col("m")), 9))
    best = rows.groupBy("chat_id", "key").agg(
        F.max(F.struct("g", "own", "c")).alias("b"), F.max(F.when(F.col("own"), F.struct("c", "g"))).alias("o"), F.first("k").alias("k"), F.first("m").alias("m")
    )
    best = best.withColumns({"source": F.col("o.c"), "own": F.col("o.g")})
    wish = best.select("chat_id", "key", "k", "m", "source", F.col("b.c").alias("target"), (F.col("b.g") - F.col("own")).alias("gain"))
    return wish.filter((F.col("target") != F.col("source")) & (F.col("gain") > LEAST_GAIN * F.col("k")))


def _in_turn(wishes: DataFrame, n: int, turn: int) -> DataFrame:
    """The wishes that are judged in a round, with a hash ``h`` that settles ties: all but where one community has more than HOT of them."""
    part = wishes.withColumn("h", F.xxhash64("key", F.lit(turn)))
    if n > HOT:  # otherwise no community can be wished for or left by more
        for c in ("source", "target"):
            crowd = wishes.groupBy("chat_id", c).count().filter(F.col("count") > HOT)  # at most n / HOT rows
            crowd = crowd.select("chat_id", c, F.ceil(F.col("count") / HOT).alias("parts"))
            part = part.join(staging.small(crowd), ["chat_id", c], "left").filter(F.col("parts").isNull() | (F.pmod("h", "parts") == 0)).drop("parts")
    return part


def _granted(ends: DataFrame, part: DataFrame, resolution: float) -> DataFrame:
    """The wishes of ``part`` that can be made together and still raise modularity, with what each surely gains (``left``).

    Wishes stand in an order dealt by a hash anew in each round. Each pays for what the wishes before it may cost it: for a neighbour that leaves the
    community it enters or enters the one it leaves, the weight of their link; for every node that enters or leaves the same community, the
    product of their weights. Who still gains is granted, so all moves together never lower modularity, and the first wish always is.
    """
    part = part.withColumn("o", F.struct("h", "key"))
    one = part.select("chat_id", "key", F.col("source").alias("s1"), F.col("target").alias("t1"), F.col("o").alias("o1"))
    two = part.select("chat_id", F.col("key").alias("other"), F.col("source").alias("s2"), F.col("target").alias("t2"), F.col("o").alias("o2"))
    clash = (F.col("t1") == F.col("s2")).cast("int") + (F.col("t2") == F.col("s1")).cast("int")
    met = ends.select("chat_id", "key", "other", "weight").join(one, ["chat_id", "key"]).join(two, ["chat_id", "other"]).filter((F.col("o2") < F.col("o1")) & (clash > 0))
    lost = met.groupBy("chat_id", "key").agg(F.sum(F.col("weight") * clash).alias("lost"))
    before = {c: F.sum("k").over(Window.partitionBy("chat_id", c).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)) for c in ("source", "target")}
    crowded = F.coalesce(before["source"], F.lit(0.0)) + F.coalesce(before["target"], F.lit(0.0))
    rows = part.withColumn("crowded", crowded).join(lost, ["chat_id", "key"], "left")
    left = F.col("gain") - F.coalesce("lost", F.lit(0.0)) - resolution * F.col("k") * F.col("crowded") / (2 * F.col("m"))
    return rows.select("chat_id", "key", "k", "m", "source", "target", left.alias("left")).filter(F.col("left") > LEAST_GAIN * F.col("k"))


def _written_together(**tables: DataFrame) -> list[DataFrame]:
    """Several tables written at the same time, as each by itself leaves most of a cluster idle when few nodes move."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(next(iter(tables.values())).sparkSession)(staging.written), df, name) for name, df in tables.items()]]


def _move(edges: DataFrame, resolution: float, rounds: int, least: float, start: DataFrame | None = None, near: DataFrame | None = None, trace: list[int] | None = None) -> DataFrame:
    """chat_id, key, community after local moves, until a round over all nodes gains less than ``least`` of modularity (0: until no node gains).

    A round looks at the nodes that are due: neighbours of what has moved, and those whose wish wasn't granted. When these gain too little, all nodes are
    looked at once more, as volumes have changed for all. ``start`` is a partition to begin with (nodes not in it stand alone), ``near`` the nodes
    due first; with it, moves go on until none of the nodes due gains, and nodes that the changes don't reach are not looked at. ``trace`` takes how many nodes were due in each round.
    """
    ends = _both_ways(edges)
    nodes = ends.groupBy("chat_id", "key").agg(F.sum("weight").alias("k")).join(edges.groupBy("chat_id").agg(F.sum("weight").alias("m")), "chat_id")
    nodes = staging.written(nodes, "nodes")
    ends = staging.written(ends.join(nodes, ["chat_id", "key"]), "ends")
    if start is not None:
        nodes = nodes.join(start.select("chat_id", "key", "community"), ["chat_id", "key"], "left").withColumn("community", F.coalesce("community", "key"))
    else:
        nodes = nodes.withColumn("community", F.col("key"))
    member = staging.written(nodes, "member")
    volume = staging.written(member.groupBy("chat_id", "community").agg(F.sum("k").alias("volume")), "volume")
    size, due = member.count(), near
    for turn in range(rounds):
        if trace is not None:
            trace.append(size if due is None else due.count())
        wishes = staging.written(_wishes(ends, member, volume, due, resolution), "wishes")
        n, gained, was_all = wishes.count(), 0.0, due is None
        if n:
            granted = staging.written(_granted(ends, _in_turn(wishes, n, turn), resolution), "granted")
            moved = granted.select("chat_id", "key", "k", "source", "target")
            # the greatest share of any chat, so that none is stopped by the others
            gained = granted.groupBy("chat_id").agg((F.sum("left") / F.first("m")).alias("g")).agg(F.max("g")).first()[0] or 0.0
            change = moved.select("chat_id", F.col("target").alias("community"), F.col("k").alias("volume"))
            change = change.unionByName(moved.select("chat_id", F.col("source").alias("community"), (-F.col("k")).alias("volume")))
            around = ends.join(moved.select("chat_id", "key"), ["chat_id", "key"], "left_semi").select("chat_id", F.col("other").alias("key"))
            member, volume, due = _written_together(
                member=member.join(moved.select("chat_id", "key", "target"), ["chat_id", "key"], "left").select("chat_id", "key", "k", "m", F.coalesce("target", "community").alias("community")),
                volume=volume.unionByName(change).groupBy("chat_id", "community").agg(F.sum("volume").alias("volume")),
                due=around.unionByName(wishes.select("chat_id", "key")).distinct(),
            )
        if not n or near is None and gained < least:
            if was_all or near is not None:
                break
            due = None
    else:
        LOG.warning("communities haven't settled in %s rounds", rounds)
    return member.select("chat_id", "key", "community")


def _lifted(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The communities as nodes, with the weight between them and, as loops, within them."""
    up = edges
    for c in ("a", "b"):
        up = up.join(found.select("chat_id", F.col("key").alias(c), F.col("community").alias(f"{c}c")), ["chat_id", c])
    up = up.select("chat_id", F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b"), "weight")
    return staging.written(up.groupBy("chat_id", "a", "b").agg(F.sum("weight").alias("weight")), "lifted")


def _levels(now: DataFrame, member: DataFrame, resolution: float, levels: int, rounds: int, least: float) -> DataFrame:
    """A partition of the nodes carried on: its communities are moved as nodes, level by level, and named by their smallest key."""
    found = member
    for _ in range(levels):
        if found.filter("key <> community").isEmpty():
            break
        now = _lifted(now, found)
        found = _move(now, resolution, rounds, least)
        member = staging.written(member.join(found.select("chat_id", F.col("key").alias("community"), F.col("community").alias("c2")), ["chat_id", "community"]).select("chat_id", "key", F.col("c2").alias("community")), "member")
    names = member.groupBy("chat_id", "community").agg(F.min("key").alias("name"))
    return member.join(names, ["chat_id", "community"]).select("chat_id", "key", F.col("name").alias("community"))


def _weighted(edges: DataFrame) -> DataFrame:
    return staging.written(edges.select("chat_id", "a", "b", F.col("weight").cast("double").alias("weight")), "edges")


def detect(edges: DataFrame, resolution: float = 1.0, levels: int = 4, rounds: int = 200, least: float = 5e-4) -> DataFrame:
    """chat_id, key, community of undirected weighted edges (chat_id, a, b, weight): local moves, then the communities as nodes, level by level.

    A community is named by its smallest key. Without edges there are no rows. Weights are above 0. No round lowers modularity. A
    level ends when a round over all nodes raises it by less than ``least`` in every chat; with 0, when no node gains by a move. One that hasn't settled
    after ``rounds`` rounds is taken as it stands, which a warning tells.
    """
    now = _weighted(edges)
    return _levels(now, _move(now, resolution, rounds, least), resolution, levels - 1, rounds, least)


def refresh(edges: DataFrame, former: DataFrame, changed: DataFrame, resolution: float = 1.0, levels: int = 4, rounds: int = 200, least: float = 5e-4, trace: list[int] | None = None) -> DataFrame:
    """The partition ``former`` (chat_id, key, community) carried on after a change of the edges, without starting anew.

    ``edges`` are all edges as they are now, ``changed`` those (chat_id, a, b) that are new, gone or of another weight. Their ends are moved first, then the
    neighbours of what has moved; nodes that no longer have edges are left out and new ones stand alone at first. The communities are then moved as
    nodes as in ``detect``. ``trace`` takes how many nodes were looked at in each round.
    """
    now = _weighted(edges)
    near = staging.written(changed.select("chat_id", F.col("a").alias("key")).unionByName(changed.select("chat_id", F.col("b").alias("key"))).distinct(), "near")
    return _levels(now, _move(now, resolution, rounds, least, former, near, trace), resolution, levels - 1, rounds, least)


def anchor_hubs(member: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """The partition with each hub (chat_id, key) in the community of its heaviest neighbour."""
    both = edges.select("chat_id", F.col("a").alias("key"), F.col("b").alias("other"), "weight")
    both = both.unionByName(edges.select("chat_id", F.col("b").alias("key"), F.col("a").alias("other"), "weight"))
    near = both.join(hubs, ["chat_id", "key"], "left_semi").join(hubs.select("chat_id", F.col("key").alias("other")), ["chat_id", "other"], "left_anti")
    near = near.join(member.select("chat_id", F.col("key").alias("other"), F.col("community").alias("c")), ["chat_id", "other"])
    to = near.groupBy("chat_id", "key").agg(F.max(F.struct("weight", "c")).alias("b")).select("chat_id", "key", F.col("b.c").alias("c"))
    return member.join(to, ["chat_id", "key"], "left").select("chat_id", "key", F.coalesce("c", "community").alias("community"))


def stale(groups: DataFrame, known: DataFrame, now: int, settings: Settings = DEFAULTS) -> DataFrame:
    """chat_id, id, action for communities (chat_id, id, node_keys) against the known ones (with last_count and embedding).

    summarise where members changed, the summary is too old or has no vector; keep; drop where it is gone.
    """
    a = groups.select("chat_id", "id", F.array_sort("node_keys").alias("new"))
    b = known.select("chat_id", "id", F.array_sort("node_keys").alias("old"), "last_count", F.col("embedding").isNotNull().alias("has_vector"))
    rows = a.join(b, ["chat_id", "id"], "full")
    fresh = F.col("old").isNull() | (F.col("new") != F.col("old")) | (now - F.col("last_count") >= settings.community_stale) | ~F.col("has_vector")
    return rows.select("chat_id", "id", F.when(F.col("new").isNull(), "drop").when(fresh, "summarise").otherwise("keep").alias("action"))


def chunks(communities: DataFrame, size: int = DEFAULTS.synthesis_chunk) -> DataFrame:
    """chat_id, id, chunk: communities in groups of ``size`` for a synthesis in two steps."""
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy("ord"))
    return communities.withColumn("chunk", F.floor((place - 1) / size).cast("int"))
