"""The entity graph: upserts, redirects, resolution, merges and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .. import staging
from ..functions import language, text, vector
from . import ranking
from .near import near


def last_segments(description: Column, cap: int) -> Column:
    """The last ``cap`` segments of a description whose segments are joined by ' | '."""
    parts = F.split(description, r" \| ")
    return F.array_join(F.when(F.size(parts) > cap, F.slice(parts, -cap, cap)).otherwise(parts), " | ")


def merge_segments(target: Column, source: Column, threshold: float = DEFAULTS.edge_jaccard) -> Column:
    """The target's description with those segments of the source that no segment so far resembles."""

    def step(all_: Column, part: Column) -> Column:
        known = F.exists(all_, lambda seen: text.jaccard(text.plain_words(seen), text.plain_words(part)) >= threshold)
        return F.when((F.trim(part) == "") | known, all_).otherwise(F.array_append(all_, part))

    def split(d: Column) -> Column:
        return F.filter(F.split(F.coalesce(d, F.lit("")), r" \| "), lambda p: F.trim(p) != "")

    return F.array_join(F.aggregate(split(source), split(target), step), " | ")


def _fold(rows: Column, cap: int) -> Column:
    """Descriptions in order, each appended unless the text so far contains it; the last ``cap`` segments."""

    def step(all_: Column, row: Column) -> Column:
        d = F.coalesce(row["description"], F.lit(""))
        return F.when((d == "") | F.contains(F.array_join(all_, " | "), d), all_).otherwise(F.slice(F.array_append(all_, d), F.greatest(F.lit(1), F.size(all_) + 2 - cap), F.lit(cap)))

    return F.array_join(F.aggregate(rows, F.array().cast("array<string>"), step), " | ")


def _last_rows(rows: DataFrame, key: list[str], cap: int) -> DataFrame:
    """(description, ord) of the last distinct descriptions of each key, in order: enough of them to fill ``cap`` segments, so a group stays small."""
    from . import ranking

    distinct = rows.filter(F.coalesce("description", F.lit("")) != "").groupBy(*key, "description").agg(F.min("ord").alias("ord"))
    return ranking.top_n(distinct, key, [F.desc("ord")], 4 * cap).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "description"))).alias("rows"))


def upsert_nodes(nodes: DataFrame, mentioned: DataFrame, cap: int = DEFAULTS.node_segments) -> DataFrame:
    """Nodes (chat_id, key, name, type, description, mentions) with the mentioned ones (chat_id, name, type, description, ord) counted in.

    First casing and type stay; a description is appended unless it is contained in what is there, and the last ``cap`` are kept.
    """
    key = ["chat_id", "key"]
    new = mentioned.withColumn("key", text.entity_key(F.col("name")))
    sums = new.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "ord").alias("new_name"), F.min_by("type", "ord").alias("new_type"))
    sums = sums.join(_last_rows(new, key, cap), key, "left")
    both = nodes.join(sums, key, "full")
    old = F.filter(F.split(F.coalesce("description", F.lit("")), r" \| "), lambda p: p != "")
    rows = F.concat(
        F.transform(old, lambda p, i: F.struct((i.cast("long") - 1_000_000).alias("ord"), p.alias("description"))),
        F.coalesce("rows", F.array().cast("array<struct<ord:bigint,description:string>>")),
    )
    return both.select(
        *key, F.coalesce("name", "new_name").alias("name"), F.coalesce("type", "new_type").alias("type"), _fold(rows, cap).alias("description"),
        (F.coalesce("mentions", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("mentions"),
    )


def upsert_edges(edges: DataFrame, said: DataFrame, nodes: DataFrame, redirects: DataFrame | None = None, cap: int = DEFAULTS.edge_segments) -> DataFrame:
    """Edges (chat_id, source, target, weight, description) with new relations (chat_id, source, target, description, ord) counted in.

    Ends are resolved by redirects; self loops and relations to unknown nodes are left out.
    """
    key = ["chat_id", "source", "target"]
    new = said.withColumns({c: text.entity_key(F.col(c)) for c in ("source", "target")})
    if redirects is not None:
        for c in ("source", "target"):
            to = redirects.select("chat_id", F.col("from_key").alias(c), F.col("to_key").alias("__to"))
            new = new.join(to, ["chat_id", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    new = new.filter("source <> target")
    for c in ("source", "target"):
        new = new.join(nodes.select("chat_id", F.col("key").alias(c)), ["chat_id", c], "left_semi")
    sums = new.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(_last_rows(new, key, cap), key, "left")
    both = edges.join(sums, key, "full")
    fresh = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<ord:bigint,description:string>>")), lambda r: r["description"]), " | ")
    merged = last_segments(merge_segments(F.col("description"), fresh), cap)
    out = both.select(*key, (F.coalesce("weight", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("weight"), merged.alias("description"))
    return out.withColumn("description_tokens", text.token_count(F.col("description")))


def needs_consolidation(edges: DataFrame, limit: int = DEFAULTS.edge_tokens) -> DataFrame:
    return edges.filter(F.col("description_tokens") > limit).select("chat_id", "source", "target")


def resolve_redirects(redirects: DataFrame, hops: int = 10) -> DataFrame:
    """chat_id, from_key, to_key: where each chain of redirects ends, after ``hops`` steps at most; a cycle ends where it closes."""
    # Rows that have arrived take a key of their own, so that the many that end at one node aren't one task in each further step. A struct, as a constant of its own would leave the keys of the join.
    def at(node: str, stay: Column) -> Column:
        return F.struct(F.col(node).alias("node"), stay.cast("int").alias("stay")).alias("at")

    few = redirects.limit(100_001).count() <= 100_000
    step = redirects.select("chat_id", at("from_key", F.lit(0)), F.col("to_key").alias("next"))
    step = step.hint("broadcast" if few else "merge")  # as many sent to every task as there are steps
    now = redirects.select("chat_id", "from_key", "to_key", F.lit(0).alias("stay"))
    for _ in range(hops - 1):
        moved = now.select("chat_id", "from_key", "to_key", at("to_key", F.col("stay"))).join(step, ["chat_id", "at"], "left")
        there = F.col("next").isNull() | (F.col("next") == F.col("from_key"))
        own = F.pmod(F.xxhash64("from_key"), F.lit(1 << 20)).cast("int") + 1
        now = moved.select("chat_id", "from_key", F.when(there, F.col("to_key")).otherwise(F.col("next")).alias("to_key"), F.when(there, own).otherwise(0).alias("stay"))
    return now.drop("stay")


def proper_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different known nodes."""
    rows = edges.filter("source <> target")
    for c in ("source", "target"):
        rows = rows.join(nodes.select("chat_id", F.col("key").alias(c)), ["chat_id", c], "left_semi")
    return rows


def undirected(edges: DataFrame, hubs: DataFrame | None = None, hub_weight: float = DEFAULTS.hub_weight) -> DataFrame:
    """chat_id, a, b, weight with a < b: both directions summed, edges of hubs (chat_id, key) made light."""
    rows = edges.filter("source <> target").select("chat_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.coalesce("weight", F.lit(1)).alias("w"))
    rows = rows.groupBy("chat_id", "a", "b").agg(F.sum("w").cast("double").alias("weight"))
    if hubs is None:
        return rows
    for c in ("a", "b"):
        rows = rows.join(hubs.select("chat_id", F.col("key").alias(c), F.lit(True).alias(f"hub_{c}")), ["chat_id", c], "left")
    hub = F.coalesce("hub_a", F.lit(False)) | F.coalesce("hub_b", F.lit(False))
    return rows.select("chat_id", "a", "b", F.when(hub, F.col("weight") * hub_weight).otherwise(F.col("weight")).alias("weight"))


def neighbours(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """chat_id, key, weight: nodes one step from the chosen ones (chat_id, key), in either direction, that aren't chosen themselves."""
    both = edges.select("chat_id", F.col("source").alias("key"), F.col("target").alias("other"), "weight")
    both = both.unionByName(edges.select("chat_id", F.col("target").alias("key"), F.col("source").alias("other"), "weight"))
    near = both.join(chosen, ["chat_id", "key"], "left_semi").groupBy("chat_id", F.col("other").alias("key")).agg(F.sum("weight").alias("weight"))
    return near.join(chosen, ["chat_id", "key"], "left_anti")


def within_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges whose ends (chat_id, key, community) lie in one community."""
    a = member.select("chat_id", F.col("key").alias("source"), "community")
    b = member.select("chat_id", F.col("key").alias("target"), "community")
    return edges.join(a, ["chat_id", "source"]).join(b, ["chat_id", "target", "community"])


def rename(nodes: DataFrame, edges: DataFrame, chat_id: str, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, redirects) with a node's key changed; a key that exists already is refused."""
    target = text.entity_key(F.lit(new))
    if not nodes.filter((F.col("chat_id") == chat_id) & (F.col("key") == target) & (F.lit(old) != target)).isEmpty():
        raise ValueError(f"there is a node {new!r} already")

    def moved(c: str) -> Column:
        return F.when((F.col("chat_id") == chat_id) & (F.col(c) == old), target).otherwise(F.col(c))

    name = F.when((F.col("chat_id") == chat_id) & (F.col("key") == old), F.lit(new)).otherwise(F.col("name"))
    redirects = nodes.sparkSession.createDataFrame([(chat_id, old)], "chat_id string, from_key string").withColumn("to_key", target).filter("from_key <> to_key")
    return nodes.withColumn("name", name).withColumn("key", moved("key")), edges.withColumns({c: moved(c) for c in ("source", "target")}), redirects


def merge_nodes(nodes: DataFrame, edges: DataFrame, merges: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, redirects) with each source node of ``merges`` (chat_id, from_key, to_key) folded into its target.

    Mentions add up, aliases and the source's name are joined, the target's vector is dropped as stale; edges move, those that meet
    add their weights, and self loops go. Chains must be resolved beforehand. Many edges are dealt into ``parts`` (``staging.parts_of``) in each step.
    """
    to = merges.select("chat_id", F.col("from_key").alias("key"), "to_key")
    placed = nodes.join(to, ["chat_id", "key"], "left").withColumn("main", F.col("to_key").isNull()).withColumn("target", F.coalesce("to_key", "key"))
    own = F.when(F.col("main"), F.struct("name", "type", "description", F.col("mentions").cast("long").alias("m")))
    grouped = placed.groupBy("chat_id", F.col("target").alias("key")).agg(
        F.max(own).alias("own"),
        F.sum("mentions").cast("long").alias("mentions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(~F.col("main"), F.array("name")).otherwise(F.array().cast("array<string>"))))))).alias("aliases"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("main"), F.col("description")))), " | ").alias("more"),
        F.max((~F.col("main")).cast("int")).alias("changed"),
    )
    new_nodes = grouped.select(
        "chat_id", "key", "own.name", "own.type", merge_segments(F.col("own.description"), F.col("more")).alias("description"), "mentions", "aliases", (F.col("changed") == 1).alias("stale_vector")
    )
    moved = edges
    for c in ("source", "target"):
        moved = staging.dealt(moved, parts, "chat_id", c).join(merges.select("chat_id", F.col("from_key").alias(c), "to_key"), ["chat_id", c], "left").withColumn(c, F.coalesce("to_key", c)).drop("to_key")
    new_edges = staging.dealt(moved.filter("source <> target"), parts, "chat_id", "source", "target").groupBy("chat_id", "source", "target").agg(F.sum("weight").cast("long").alias("weight"))
    return new_nodes, new_edges, merges.select("chat_id", "from_key", "to_key")


def delete_nodes(nodes: DataFrame, edges: DataFrame, redirects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, redirects) without the nodes ``gone`` (chat_id, key), their edges, and redirects from or to them."""
    for c in ("source", "target"):
        edges = edges.join(gone.select("chat_id", F.col("key").alias(c)), ["chat_id", c], "left_anti")
    for c in ("from_key", "to_key"):
        redirects = redirects.join(gone.select("chat_id", F.col("key").alias(c)), ["chat_id", c], "left_anti")
    return nodes.join(gone.select("chat_id", "key"), ["chat_id", "key"], "left_anti"), edges, redirects


def name_candidates(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """chat_id, name, key, distance: people whose name matches a node's in the other script.

    Cyrillic names are transliterated; the distance allowed is 1 for names of up to four letters and 2 else. Pairs are joined on
    a deletion neighbourhood: two strings within distance 2 share a form with up to two letters left out.
    """
    def sides(df: DataFrame, key: str, name: str) -> DataFrame:
        k = F.col(key)
        return df.select("chat_id", k.alias(name), language.transliterate(k).alias(f"{name}_latin"), k.rlike(r"\p{IsCyrillic}").alias(f"{name}_cyrillic"))

    a = sides(new.withColumn("k", text.entity_key(F.col("name"))).filter(F.col("type") == "PERSON"), "k", "name")
    b = sides(nodes.filter(F.col("type") == "PERSON"), "key", "key")
    forms_a = a.withColumn("form", F.explode(language.deletions(F.col("name_latin"))))
    forms_b = b.withColumn("form", F.explode(language.deletions(F.col("key_latin"))))
    pairs = forms_a.join(forms_b, ["chat_id", "form"]).filter("name_cyrillic <> key_cyrillic").drop("form").distinct()
    limit = F.when(F.least(F.length("name"), F.length("key")) <= 4, 1).otherwise(2)
    pairs = pairs.withColumn("distance", F.levenshtein("name_latin", "key_latin")).filter(F.col("distance") <= limit)
    return pairs.select("chat_id", "name", "key", "distance")


def common_run(a: Column, b: Column, length: Column) -> Column:
    """Whether two texts share a substring of ``length`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - length + 1))
    return (length > 0) & (length <= F.length(a)) & F.exists(starts, lambda i: F.contains(b, F.substr(a, i, length)))


def name_parts(df: DataFrame, key: str, stem=language.stems) -> DataFrame:
    """``df`` with what comparing keys takes: ``words`` without stop words, their stems of two letters or more, and the key's own stem."""
    found = F.array_distinct(F.filter(F.split(F.col(key), r"\s+"), lambda w: (F.length(w) > 0) & ~w.isin(*text.STOP_WORDS)))
    rows = df.withColumn("words", found).withColumn("stems", F.array_distinct(F.filter(stem(found), lambda w: F.length(w) >= 2)))
    return rows.withColumn("key_stem", F.element_at(stem(F.array(F.col(key))), 1))


def overlapping_names(a: str, b: str, x: dict[str, Column], y: dict[str, Column], ratio: float = DEFAULTS.token_overlap) -> Column:
    """Whether two keys may name one thing; x and y hold their ``words``, ``stems`` and ``key_stem``.

    Their stems are equal, one contains the other, they share a run of characters of 0.85 of the shorter one (of at least 4; of keys of up to four letters 0.6, of at
    least 2), or of the smaller one's words, or stems of words, ``ratio`` or more are shared.
    """
    p, q = F.col(a), F.col(b)
    least = F.least(F.length(p), F.length(q))
    short = (F.length(p) <= 4) & (F.length(q) <= 4)
    run = F.when(short, F.greatest(F.lit(2), F.ceil(least * 0.6 - 1e-9))).otherwise(F.greatest(F.lit(4), F.ceil(least * 0.85 - 1e-9))).cast("int")
    lettered = (F.length(p) > 2) & (F.length(q) > 2)

    def share(kind: str) -> Column:
        smaller = F.least(F.size(x[kind]), F.size(y[kind]))
        return (smaller > 0) & (F.size(F.array_intersect(x[kind], y[kind])) >= ratio * smaller)

    worded = (F.size(x["words"]) > 0) & (F.size(y["words"]) > 0)
    return (x["key_stem"] == y["key_stem"]) | F.contains(p, q) | F.contains(q, p) | (lettered & common_run(p, q, run)) | (worded & (share("words") | share("stems")))


def near_pairs(new: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """chat_id, type, name, key of all pairs of a new entity (chat_id, type, name, va) and a node (chat_id, type, key, vb) whose vectors' cosine may be ``least`` or more, compared by blocks (``near``)."""
    key = ["chat_id", "type"]
    found = near(new.select(*key, F.col("name").alias("l"), "va"), nodes.select(*key, F.col("key").alias("r"), "vb"), key, least)
    return staging.written(found.toDF(*key, "name", "key"), "near-pairs")


def similar_nodes(new: DataFrame, nodes: DataFrame, settings: Settings = DEFAULTS, stem=language.stems) -> DataFrame:
    """chat_id, name, key, s: for each new entity (chat_id, name, own, type, embedding) the most similar node of its type that it may be merged with.

    People are merged by the cosine of their vectors alone; they, below it, and all others at a cosine lower by 0.1 at most whose names overlap. Only pairs that
    can reach that cosine are compared (``near_pairs``).
    """
    t = settings.entity_merge
    a = new.select("chat_id", "name", "own", "type", F.col("embedding").alias("va"))
    b = nodes.select("chat_id", "key", "type", F.col("embedding").alias("vb"))
    if t - 0.1 <= 0:
        raise ValueError("entities are merged from a cosine above 0.1 on")
    may_be = near_pairs(a, b, t - 0.1)
    pairs = may_be.join(a.drop("own"), ["chat_id", "type", "name"]).join(b, ["chat_id", "type", "key"]).withColumn("s", vector.cosine(F.col("va"), F.col("vb"))).filter(F.col("s") >= t - 0.1)
    x = name_parts(new.select("chat_id", "type", "name", "own"), "own", stem).select("chat_id", "type", "name", "own", *[F.col(c).alias(f"x_{c}") for c in ("words", "stems", "key_stem")])
    y = name_parts(nodes.select("chat_id", "type", "key"), "key", stem).select("chat_id", "type", "key", *[F.col(c).alias(f"y_{c}") for c in ("words", "stems", "key_stem")])
    pairs = pairs.select("chat_id", "type", "name", "key", "s").join(x, ["chat_id", "type", "name"]).join(y, ["chat_id", "type", "key"])
    u, v = ({c: F.col(f"{side}{c}") for c in ("words", "stems", "key_stem")} for side in ("x_", "y_"))
    may = ((F.col("type") == "PERSON") & (F.col("s") >= t)) | overlapping_names("own", "key", u, v, settings.token_overlap)
    return pairs.filter(may).groupBy("chat_id", "name").agg(F.max(F.struct("s", "key")).alias("m")).select("chat_id", "name", "m.key", "m.s")


def resolve_entities(new: DataFrame, nodes: DataFrame, settings: Settings = DEFAULTS, stem=language.stems) -> DataFrame:
    """chat_id, name, key, stage: the node of each new entity (chat_id, name, type, embedding).

    exact key, then a name in the other script, then the most similar node that it may be merged with, else a node of its own.
    """
    rows = new.withColumn("key", text.entity_key(F.col("name"))).dropDuplicates(["chat_id", "key"])
    exact = rows.join(nodes.select("chat_id", "key"), ["chat_id", "key"], "left_semi").select("chat_id", "name", "key", F.lit("exact").alias("stage"))
    left = rows.join(exact.select("chat_id", "key"), ["chat_id", "key"], "left_anti")
    script = name_candidates(left, nodes).groupBy("chat_id", "name").agg(F.min(F.struct("distance", "key")).alias("m")).select("chat_id", F.col("name").alias("key"), F.col("m.key").alias("to"))
    script = left.select("chat_id", "name", "key").join(script, ["chat_id", "key"]).select("chat_id", "name", F.col("to").alias("key"), F.lit("script").alias("stage"))
    left = left.join(script.select("chat_id", "name"), ["chat_id", "name"], "left_anti")
    similar = similar_nodes(left.withColumnRenamed("key", "own"), nodes, settings, stem).select("chat_id", "name", "key", F.lit("similar").alias("stage"))
    fresh = left.join(similar.select("chat_id", "name"), ["chat_id", "name"], "left_anti").select("chat_id", "name", "key", F.lit("new").alias("stage"))
    return exact.unionByName(script).unionByName(similar).unionByName(fresh)


def update_graph(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame, settings: Settings = DEFAULTS, stem=language.stems) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, redirects) after a batch of entities (chat_id, name, type, description, embedding, ord) and relations (chat_id, source, target, description, ord).

    Entities named Unknown are skipped. An entity that is found to be a known node counts as a mention of it, and its own key redirects there; relations follow the redirects.
    """
    known = entities.filter(F.lower(F.trim("name")) != "unknown")
    found = staging.cut(resolve_entities(known, nodes, settings, stem))
    redirects = found.withColumn("from_key", text.entity_key(F.col("name"))).filter("from_key <> key").select("chat_id", "from_key", F.col("key").alias("to_key"))
    to = found.select("chat_id", text.entity_key(F.col("name")).alias("k"), F.col("key").alias("__to"))
    # an entity takes the name of the node that it was found to be; a node of its own keeps the name it came with
    moved = known.withColumn("k", text.entity_key(F.col("name"))).join(to, ["chat_id", "k"]).withColumn("name", F.when(F.col("k") == F.col("__to"), F.col("name")).otherwise(F.col("__to")))
    new_nodes = upsert_nodes(nodes.select("chat_id", "key", "name", "type", "description", "mentions"), moved.select("chat_id", "name", "type", "description", "ord"), settings.node_segments)
    plain = relations.filter((F.lower(F.trim("source")) != "unknown") & (F.lower(F.trim("target")) != "unknown"))
    return new_nodes, upsert_edges(edges, plain, new_nodes, redirects, settings.edge_segments), redirects


def around(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a set of entities (chat_id, name): nodes with such a name, and edges with an end among them."""
    chosen = nodes.join(names.select("chat_id", F.lower("name").alias("__k")).distinct(), (nodes["chat_id"] == names["chat_id"]) & (F.lower(nodes["name"]) == F.col("__k")), "left_semi")
    keys = chosen.select("chat_id", "key")
    ends = edges.select("chat_id", "source", "target", F.explode(F.array("source", "target")).alias("key")).join(keys, ["chat_id", "key"], "left_semi").select("chat_id", "source", "target").distinct()
    return chosen, edges.join(ends, ["chat_id", "source", "target"], "left_semi")


def merge_target(inputs: DataFrame, nodes: DataFrame) -> DataFrame:
    """chat_id, input, key: the node that a typed text means: its name or an alias, whatever the case and with or without the type in brackets; of several the first."""
    typed = inputs.withColumn("k", F.lower(F.trim(F.regexp_replace("input", r"\s*\[[^\]]*\]\s*$", ""))))
    names = F.array_union(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)))
    known = nodes.select("chat_id", "key", "ord", F.explode(names).alias("k"))
    return typed.join(known, ["chat_id", "k"]).groupBy("chat_id", "input").agg(F.min_by("key", F.struct("ord", "key")).alias("key"))


def relationship_levels(events: DataFrame) -> DataFrame:
    """chat_id, first, second, trust, tension of pairs that events (chat_id, ord, impact: map of "A->B" to a text) tell of.

    Trust starts at 5 and tension at 0; each text that speaks of an increase or a decrease moves one by 1 and never beyond 0 to 10. The steps of a pair are
    folded in their order as runs: a run of steps is described by what it adds between two bounds, and two runs make a third, so no pair is gathered.
    """
    rows = events.select("chat_id", "ord", F.explode("impact").alias("k", "said")).withColumn("said", F.lower("said"))
    pair = rows.filter(F.col("k").rlike(r"^.+?\s*->\s*.+$")).select(
        "chat_id", "ord", F.regexp_extract("k", r"^(.+?)\s*->\s*(.+)$", 1).alias("first"), F.regexp_extract("k", r"^(.+?)\s*->\s*(.+)$", 2).alias("second"), "said"
    )
    key = ["chat_id", "first", "second"]

    def step(word: str) -> Column:
        up = F.contains("said", F.lit(word)) & F.contains("said", F.lit("increas"))
        down = F.contains("said", F.lit(word)) & F.contains("said", F.lit("decreas"))
        return F.when(up, 1).when(down, -1).otherwise(0)

    steps = pair.select(*key, "ord", step("trust").alias("d_trust"), step("tension").alias("d_tension"))
    # x -> min(hi, max(lo, x + add)); stretches of 256 by place are folded, then stretches of stretches
    level = steps.groupBy(*key, F.floor(F.col("ord") / 256).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("ord", "d_trust", "d_tension"))).alias("l"))

    def whole(items: Column, field: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("add"), F.lit(0).cast("long").alias("lo"), F.lit(10).cast("long").alias("hi"))

        def then(s: Column, x: Column) -> Column:
            d = x[field].cast("long")
            bound = lambda v: F.least(F.lit(10), F.greatest(F.lit(0), v + d)).cast("long")
            return F.struct((s["add"] + d).alias("add"), bound(s["lo"]).alias("lo"), bound(s["hi"]).alias("hi"))

        return F.aggregate(items, start, then)

    level = level.select(*key, "stretch", whole(F.col("l"), "d_trust").alias("trust"), whole(F.col("l"), "d_tension").alias("tension"))
    per = level.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("stretch", "trust", "tension"))).alias("l"))

    def final(field: str, start: int) -> Column:
        def then(x: Column, s: Column) -> Column:
            return F.least(s[field]["hi"], F.greatest(s[field]["lo"], x + s[field]["add"]))

        return F.aggregate("l", F.lit(start).cast("long"), then)

    return per.select(*key, final("trust", 5).alias("trust"), final("tension", 0).alias("tension"))
