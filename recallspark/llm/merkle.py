"""A Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from its root.

Rows become leaves. The leaves of a language are put in order and hashed in runs of eight until one digest, the
language's subroot, remains; the subroots are hashed likewise into the root. What is stored are records (digest, children) by height.
A proof is read from the records alone: a leaf's request starts at the root, its rank's octal digits tell which child to take at each record,
the other children are collected, and the segments so collected are reversed at the end. Requests that share a prefix of digits descend
as one row, so no join carries all requests to the root's record. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nodes that are hashed into one.
ARITY = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IN_PART = (1 << 33) - 1  # monotonically_increasing_id has the row's number in its lower 33 bits


def field(value: Column) -> Column:
    """A value so that no two lists of fields give the same bytes: ``-`` for null, else byte count, colon, value."""
    told = value.cast("string")
    return F.when(told.isNull(), "-").otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))


def leaf(text: Column) -> Column:
    """A document's leaf, with ``text`` for its text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def tampered_leaf() -> Column:
    """The leaf after the letters A-Z of the text were lowered, where 3 divides the crc32 of doc_id; null for other documents."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf(F.translate("text", _UPPER, _UPPER.lower())))


def placed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df``, written, with ``place``: each row's number from 0 in the order of ``keys`` over the whole table.

    Ranges of the keys are sorted each in a task, rows are numbered within a range, and the sizes of the ranges before it are added. No
    window spans more than the list of ranges.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ranged = common.materialize(ranged, name).withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    met = ranged.join(F.broadcast(offsets), "__part")  # a row for each range, that is for each task of the sort
    return met.withColumn("place", F.col("__before") + F.col("__at").bitwiseAND(F.lit(_IN_PART))).drop("__part", "__before", "__at")


def _run(idx: str = "idx") -> Column:
    return F.expr(f"{idx} div {ARITY}")


def _digit(idx: str = "idx") -> Column:
    return F.expr(f"cast({idx} % {ARITY} as int)")


def build(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(records by height, roots) of trees over ``nodes`` (tree, idx, digest, n), where n nodes of a tree are numbered from 0.

    ``records[h - 1]`` has the records (digest, children) of height h, each digest once; ``roots`` has tree, digest, height. Each level is written,
    and is an eighth of the one below.
    """
    records, roots, height = [], [], 0
    while True:
        roots.append(nodes.filter("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        more = nodes.filter("n > 1")
        if more.isEmpty():
            break
        runs = more.groupBy("tree", _run().alias("idx")).agg(F.array_sort(F.collect_list(F.struct(_digit().alias("d"), "digest"))).alias("c"), F.first("n").alias("n"))
        told = runs.select("tree", "idx", F.transform("c", lambda x: x["digest"]).alias("children"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        nodes = common.materialize(told.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{name}-{height + 1}")
        records.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
        height += 1
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return records, common.materialize(found, f"{name}-roots")


def descend(roots: DataFrame, records: list[DataFrame], floor: int, wanted: DataFrame | None = None) -> DataFrame:
    """The nodes of height ``floor`` below ``roots`` (tree, digest, height, path and more), found record by record.

    Gives tree, idx, digest, path and the roots' other columns. ``path`` gets a segment (left, right) of unselected children for each record
    passed, the root's first. Trees lower than ``floor`` come with their root. ``wanted`` (tree, idx of leaves) leaves out nodes that lead to none of them.
    """
    carried = [c for c in roots.columns if c not in ("digest", "height", "path")]
    low = roots.filter(F.col("height") <= floor).withColumn("idx", F.lit(0).cast("long")).drop("height")
    front = None
    for height in range(len(records), floor, -1):
        start = roots.filter(F.col("height") == height).withColumn("idx", F.lit(0).cast("long")).drop("height")
        front = start if front is None else front.unionByName(start)
        met = front.join(records[height - 1], "digest").select(*carried, "idx", "path", "children", F.posexplode("children").alias("d", "digest"))
        rest = F.size("children") - F.col("d") - 1
        segment = F.struct(
            F.array_join(F.slice("children", 1, F.col("d")), "").alias("left"),
            F.array_join(F.slice("children", F.col("d") + 2, rest), "").alias("right"),
        )
        front = met.select(*carried, (F.col("idx") * ARITY + F.col("d")).alias("idx"), "digest", F.concat("path", F.array(segment)).alias("path"))
        if wanted is not None:
            front = front.join(wanted.select("tree", F.expr(f"idx div {ARITY ** (height - 1)}").alias("idx")).distinct(), ["tree", "idx"], "left_semi")
    return low if front is None else low.unionByName(front)


@dataclass
class Manifest:
    """``leaves`` (tree, idx, n, lang, doc_id, leaf, tampered), the records of the trees and of the tree over their roots, ``trees`` (tree, lang, subroot, height), ``root``."""

    leaves: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    trees: DataFrame
    root: str | None
    top_height: int

    def prove(self, requests: DataFrame | None = None) -> DataFrame:
        """doc_id, lang, leaf, subroot, root, path, tampered of all documents, or of those whose doc_id is among ``requests``.

        ``path`` has the segments (left, right) of the leaf's siblings from the leaf's level up to the root's.
        """
        leaves = self.leaves
        if requests is not None:
            leaves = leaves.join(requests.select("doc_id").distinct(), "doc_id", "left_semi")
        wanted = None if requests is None else leaves.select("tree", "idx")
        empty = F.expr("cast(array() as array<struct<left string, right string>>)")
        start = self.trees.limit(0 if self.root is None else 1).select(F.lit(0).cast("long").alias("tree"), F.lit(self.root).alias("digest"), F.lit(self.top_height).alias("height"), empty.alias("path"))
        tops = descend(start, self.top_records, 0).select(F.col("idx").alias("tree"), "path")
        roots = tops.join(self.trees, "tree").select("tree", F.col("subroot").alias("digest"), "height", "path", "lang", "subroot")
        runs = descend(roots, self.records, 1, wanted)
        if self.records:
            runs = runs.join(self.records[0], "digest", "left")
        else:
            runs = runs.withColumn("children", F.lit(None).cast("array<string>"))
        asked = leaves.groupBy("tree", _run().alias("idx")).agg(F.first("n").alias("n"), F.collect_list(F.struct(_digit().alias("d"), "doc_id", "tampered")).alias("asked"))
        met = asked.join(runs, ["tree", "idx"]).select("lang", "subroot", "path", "n", F.coalesce("children", F.array("digest")).alias("children"), F.inline("asked"))
        d = F.col("d")
        own = F.array(F.struct(F.array_join(F.slice("children", 1, d), "").alias("left"), F.array_join(F.slice("children", d + 2, F.size("children") - d - 1), "").alias("right")))
        path = F.concat(F.when(F.col("n") > 1, own).otherwise(empty), F.reverse("path"))
        return met.select("doc_id", "lang", F.element_at("children", d + 1).alias("leaf"), "subroot", F.lit(self.root).alias("root"), path.alias("path"), "tampered")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]), 256))


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text), each of which may be null.

    Leaves of a language ascend by doc_id, null first; rows that repeat a doc_id are ordered by their leaf, and rows that repeat all columns have equal leaves, so any order of
    these gives the same digests. A null lang is a language of its own, before all others. Empty and null texts differ. Texts of any length are read once and
    whole. An empty table has no root. Other columns are ignored.
    """
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), tampered_leaf().alias("tampered"))
    leaves = common.materialize(leaves, "merkle-leaves").withColumn("__row", F.monotonically_increasing_id())
    ordered = placed(leaves, ["lang", "doc_id", "leaf", "__row"], "merkle-order").drop("__row").withColumn("__lang", field(F.col("lang")))
    langs = ordered.groupBy("__lang").agg(F.first("lang").alias("lang"), F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    langs = placed(common.materialize(langs, "merkle-langs"), ["lang"], "merkle-trees").withColumnRenamed("place", "tree")
    rows = ordered.count()
    leaves = common.join_by_count(ordered.drop("lang"), langs.select("__lang", "lang", "start", "tree", "n"), "__lang", "n", rows)
    leaves = common.materialize(leaves.select("tree", (F.col("place") - F.col("start")).alias("idx"), "n", "lang", "doc_id", "leaf", "tampered"), "merkle-placed")
    records, roots = build(leaves.select("tree", "idx", F.col("leaf").alias("digest"), "n"), "merkle")
    trees = common.materialize(roots.join(langs.select("tree", "lang"), "tree").withColumnRenamed("digest", "subroot"), "merkle-subroots")
    n = F.lit(trees.count()).cast("long")
    top_records, top = build(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), n.alias("n")), "merkle-top")
    root = top.first()
    return Manifest(leaves, records, top_records, trees, root and root["digest"], root["height"] if root else 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that the leaf, tampered with or not, folds to."""
    proofs = manifest(common.read_table(spark, sf_dir, "documents")).prove()
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.col("path"), F.coalesce("tampered", "leaf"))
    told = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int, top_levels: int) -> str:
    """The same in SQL, level by level; for at most 8^levels leaves of a language and 8^top_levels languages."""

    def told(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"

    head = " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars"))
    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: " + step.format(c="b") + ")"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, x: {bits}), 4294967295)"
    lowered = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    parts = [f"""d AS (SELECT lang, doc_id, sha256({head} || {told('text')}) AS leaf,
      CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {told(lowered)}) END AS tampered FROM documents)""",
      "p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d)",
      "l0 AS (SELECT tree, idx, leaf AS digest, n FROM p)"]

    def up(kind: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"{kind}{k + 1} AS (SELECT tree, idx // 8 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest, "
                f"(any_value(n) + 7) // 8 AS n FROM {kind}{k} GROUP BY tree, idx // 8)"
            )
            parts.append(
                f"{kind}s{k} AS (SELECT tree, idx, n > 1 AS deep, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(digest, '') OVER (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {kind}{k})"
            )

    up("l", levels)
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS idx, digest, count(*) OVER () AS n FROM l{levels})")
    up("t", top_levels)
    parts.append(f"f0 AS (SELECT p.*, coalesce(tampered, leaf) AS h, '' AS proof, s.digest AS subroot, r.digest AS root FROM p JOIN l{levels} s ON s.tree = p.tree CROSS JOIN t{top_levels} r)")
    steps = [(f"ls{k}", "s.tree = f.tree AND s.idx = f.idx", k) for k in range(levels)] + [(f"ts{k}", "s.idx = f.tree", k) for k in range(top_levels)]
    for i, (table, on, k) in enumerate(steps):
        on = on.replace("f.idx", f"f.idx // {8 ** k}") if table[0] == "l" else on.replace("f.tree", f"f.tree // {8 ** k}")
        parts.append(f"f{i + 1} AS (SELECT f.* REPLACE (CASE WHEN deep THEN sha256(l || h || r) ELSE h END AS h, CASE WHEN deep THEN proof || l || r ELSE proof END AS proof) FROM f{i} f JOIN {table} s ON {on})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f{len(steps)}"


ORACLE = _oracle(6, 3)
