"""Pairs of vectors with a high cosine, by blocks: exact, and nothing is shuffled for a pair that isn't near."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import staging
from ..functions import vector
from ..shipping import ship_code
from . import ranking

#: Rows of a block, and rows of it that are multiplied with another block at once.
BLOCK, STRIPE = 8192, 512
#: Rows of a block where only the k best leave it, of which each further block makes k more.
WIDE = 16384
#: What a product of blocks may differ from the cosine by.
SLACK = 1e-6


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def by_blocks(left: DataFrame, right: DataFrame, key: list[str], compare, schema, block: int = BLOCK, arrow: bool = False) -> DataFrame:
    """What ``compare`` makes of each pair of blocks of ``left`` (key, l, ...) and ``right`` (key, r, ...) of equal keys, both written, of about ``block`` rows each.

    A block is shuffled once for each block of the other side; nothing else is. ``compare`` is given data frames of Pandas, or with ``arrow`` tables of Arrow.
    """
    ship_code(left.sparkSession)

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    cells = staging.written(parts(left, "__ls").join(parts(right, "__rs"), key), "near-cells")
    files = cells.inputFiles()
    again = cells.sparkSession.read.schema(cells.schema).parquet(*files) if files else cells.sparkSession.createDataFrame([], cells.schema)
    dealt, every = (lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    a = left.join(F.broadcast(cells), key).select(*left.columns, dealt("l", "__ls").alias("__lp"), every("__rs").alias("__rp"))
    b = right.join(F.broadcast(again), key).select(*right.columns, dealt("r", "__rs").alias("__rp"), every("__ls").alias("__lp"))
    place = [*key, "__lp", "__rp"]
    met = a.groupBy(*place).cogroup(b.groupBy(*place))
    return met.applyInArrow(compare, schema) if arrow else met.applyInPandas(compare, schema)


def near(left: DataFrame, right: DataFrame, key: list[str], at_least: float, k: int | None = None, scored: bool = False, block: int = BLOCK) -> DataFrame:
    """key, l, r: the pairs of ``left`` (key, l, va) and ``right`` (key, r, vb) of equal keys whose cosine may be ``at_least`` or more, or with ``k`` only those that may be among the k best of l.

    Both sides of a key are dealt into blocks, and each pair of blocks is one product of matrices in one task, which gives on only what is near. So the products grow with the square of a key's
    rows, but what is shuffled is each block once for each block of the other side. A few pairs just below are found too: take the cosine of what is found; ``scored`` adds it as ``s``, to within SLACK.
    Missing and zero vectors, and such of different lengths, are like nothing.
    """
    group = [*key, "__dim"]

    def usable(df: DataFrame, v: str) -> DataFrame:
        return df.filter(F.col(v).isNotNull() & (vector.norm(F.col(v)) > 0)).withColumns({v: F.col(v).cast("array<double>"), "__dim": F.size(v)})

    one, two = usable(left.select(*key, "l", "va"), "va"), usable(right.select(*key, "r", "vb"), "vb")

    def products(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [x.iloc[:0][[*key, "l"]].assign(r=y["r"].iloc[:0].to_numpy(), **({"s": np.empty(0)} if scored else {}))]
        if len(x) and len(y):
            p, q = _unit(x["va"]), _unit(y["vb"]).T
            for i in range(0, len(p), STRIPE):
                s = p[i : i + STRIPE] @ q
                keep = s >= at_least - SLACK
                if k is not None and s.shape[1] > k:
                    keep &= s >= np.partition(s, -k, axis=1)[:, -k][:, None] - SLACK
                at, to = np.nonzero(keep)
                if len(at):
                    found.append(x.iloc[i + at][[*key, "l"]].assign(r=y["r"].to_numpy()[to], **({"s": s[at, to]} if scored else {})))
        return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    schema = StructType([*[left.schema[c] for c in [*key, "l"]], right.schema["r"]])
    if scored:
        schema = schema.add("s", "double")
    return by_blocks(staging.written(one, "near-left"), staging.written(two, "near-right"), group, products, schema, block)


def best(left: DataFrame, right: DataFrame, key: list[str], at_least: float, k: int) -> DataFrame:
    """l, r: the pairs that may be among the k best of l over all its keys, of those that ``near`` finds in each block: about k for each l. Their cosine is to be taken.

    Ties go to the smaller r, so of equal vectors of a key only the k smallest r are compared.
    """
    first = Window.partitionBy(*key, "vb").orderBy("r")
    right = right.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k).drop("__n")
    found = staging.written(near(left, right, key, at_least, k, True, WIDE).select("l", "r", "s"), "near-best")
    kth = ranking.top_n(found, ["l"], [F.desc("s")], k).groupBy("l").agg(F.min("s").alias("kth"), F.count(F.lit(1)).alias("n"))
    floor = kth.select("l", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    return found.join(floor, "l").filter(F.col("kth").isNull() | (F.col("s") >= F.col("kth") - 2 * SLACK)).select("l", "r").distinct()
