"""A vector index that is kept: lists by centroid with quantised residuals, grown by appended files, searched with bounds.

Vectors have length one when stored, so a dot product is a cosine. A member of a list is its centroid plus a residual, of which one signed byte for each number is
kept beside the error's length. A change never rewrites what is there: inserts append files to the lists, deletions append marks, and what is read is what no
later mark covers. ``compacted`` writes a clean index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..functions import vector
from ..operators import near, ranking

MEMBERS = "chat_id string, id long, seq long, code array<tinyint>, scale double, error double, along double, list int"
FULL = "chat_id string, id long, seq long, unit array<float>"
MARKS = "chat_id string, id long, seq long"
#: Rows that a k-means of the centroids is fitted on at most, about.
SAMPLE = 50_000


def unit(embedding: Column) -> Column:
    """The vector at length one; null where it is missing or all zeros."""
    size = vector.norm(embedding)
    return F.when(size > 0, F.transform(embedding, lambda x: (x / size).cast("float")))


class ListIndex:
    """Tables below ``folder``: ``centroids`` (list, centroid), ``members`` by list, ``full`` (whole vectors for the last step) and ``marks``.

    A row of ``members`` or ``full`` counts if no mark of its chat and id, or of its chat alone, has a greater ``seq``. Each change has a number of its own, greater than those before it;
    a change that failed is simply made again under the same number, as its rows are then the same.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, vectors: DataFrame, folder: str, lists: int, seed: int = 7) -> ListIndex:
        """An index of vectors (chat_id, id, embedding) with centroids fitted by cosine k-means on about SAMPLE of them, those with the smallest hash of their id."""
        index = cls(vectors.sparkSession, folder)
        usable = vectors.select("id", unit(F.col("embedding")).alias("unit")).filter("unit is not null")
        n = usable.count()
        fitted = usable if n <= SAMPLE else usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
        features = fitted.select(array_to_vector(F.col("unit").cast("array<double>")).alias("features")).coalesce(index.spark.sparkContext.defaultParallelism)
        centres = KMeans(k=max(2, lists), distanceMeasure="cosine", seed=seed, maxIter=10).fit(features).clusterCenters() if n else []
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        made = index.spark.createDataFrame(rows, "list int, centroid array<double>")
        made.select("list", F.transform(unit(F.col("centroid")), lambda x: x.cast("double")).alias("centroid")).filter("centroid is not null").coalesce(1).write.parquet(f"{folder}/centroids")
        index.insert(vectors, 1)
        return index

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def centroids(self) -> DataFrame:
        """One row for each list, so it is sent to every task."""
        return F.broadcast(self._read("centroids", "list int, centroid array<double>"))

    def _live(self, rows: DataFrame) -> DataFrame:
        marks = self._read("marks", MARKS).groupBy("chat_id", "id").agg(F.max("seq").alias("marked"))
        one, all_ = marks.filter("id is not null"), marks.filter("id is null").select("chat_id", F.col("marked").alias("purged"))
        met = rows.join(one, ["chat_id", "id"], "left").join(all_, "chat_id", "left")
        return met.filter((F.coalesce("marked", F.lit(-1)) <= F.col("seq")) & (F.coalesce("purged", F.lit(-1)) <= F.col("seq"))).drop("marked", "purged")

    def members(self) -> DataFrame:
        return self._live(self._read("members", MEMBERS))

    def full(self) -> DataFrame:
        return self._live(self._read("full", FULL))

    def insert(self, rows: DataFrame, seq: int) -> None:
        """Add vectors; an id that is there already is replaced. Vectors that are missing or zero only take the old one away. Of an id that comes twice one is kept, the smaller vector."""
        seq_ = F.lit(seq).cast("long").alias("seq")
        told = rows.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("id").cast("long").alias("id"), unit(F.col("embedding")).alias("unit"))
        told = staging.written(told.groupBy("chat_id", "id").agg(F.min("unit").alias("unit")), "vectors")
        self._mark(told, seq)
        kept = told.filter("unit is not null")
        kept.select("chat_id", "id", seq_, "unit").write.mode("append").parquet(f"{self.folder}/full")
        every = F.broadcast(self.centroids().agg(F.collect_list(F.struct("list", "centroid")).alias("__c")))  # one row, which each vector looks through where it is read
        along = F.transform("__c", lambda c: F.struct(vector.dot(F.col("unit"), c["centroid"]).alias("along"), (-c["list"]).alias("__l"), c["list"].alias("list"), c["centroid"].alias("centroid")))
        placed = kept.join(every, F.lit(True)).withColumn("m", F.array_max(along)).filter("m is not null").select("chat_id", "id", "unit", "m.list", "m.centroid", "m.along")
        residual = placed.withColumn("r", F.zip_with("unit", "centroid", lambda x, c: x.cast("double") - c)).withColumn("scale", F.array_max(F.transform("r", lambda x: F.abs(x))) / 127)
        coded = residual.withColumn("code", F.transform("r", lambda x: F.when(F.col("scale") > 0, F.round(x / F.col("scale"))).otherwise(0).cast("tinyint")))
        miss = F.zip_with("r", "code", lambda x, c: x - c * F.col("scale"))
        coded.select("chat_id", "id", seq_, "code", "scale", vector.norm(miss).alias("error"), "along", "list").write.mode("append").partitionBy("list").parquet(f"{self.folder}/members")

    def _mark(self, ids: DataFrame, seq: int) -> None:
        ids.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("id").cast("long").alias("id"), F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(f"{self.folder}/marks")

    def delete(self, ids: DataFrame, seq: int) -> None:
        """Take vectors (chat_id, id) away; ids that aren't there don't matter. Their rows stay until the index is compacted, but count no more."""
        self._mark(ids, seq)

    def purge(self, chat_id: str, seq: int) -> None:
        self._mark(self.spark.createDataFrame([(chat_id, None)], "chat_id string, id long"), seq)

    def compacted(self, folder: str) -> ListIndex:
        """The same index in another folder, without what is covered by marks, its changes numbered from 2 on again."""
        self._read("centroids", "list int, centroid array<double>").write.parquet(f"{folder}/centroids")
        one = F.lit(1).cast("long").alias("seq")
        self.full().select("chat_id", "id", one, "unit").write.parquet(f"{folder}/full")
        self.members().select("chat_id", "id", one, "code", "scale", "error", "along", "list").write.partitionBy("list").parquet(f"{folder}/members")
        return ListIndex(self.spark, folder)

    def search(self, queries: DataFrame, k: int, probes: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
        """(query_id, chat_id, id, similarity, place of the k vectors of its chat most like each query; query_id, list of the lists that were scanned).

        ``queries`` has query_id, chat_id and query_vector. The ``probes`` lists with the nearest centroids are scanned by their bytes, and what the error allows to be among the k best is compared
        whole. With ``exact`` lists follow in which, by the angle that their members keep to the centroid, a vector as near as the k-th found may lie; nothing is then missed.
        """
        asked = queries.select("query_id", "chat_id", unit(F.col("query_vector")).alias("q")).filter("q is not null")
        asked = staging.written(asked, "asked")
        members = self.members()
        reach = members.groupBy("list").agg(F.min("along").alias("least"))
        by_list = asked.join(self.centroids(), F.lit(True)).select("query_id", "chat_id", "q", "list", vector.dot(F.col("q"), F.col("centroid")).alias("along_q"))
        by_list = by_list.join(F.broadcast(reach), "list")  # a row for each list
        turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("along_q")))) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least"))))
        by_list = staging.written(by_list.withColumn("bound", F.cos(F.greatest(F.lit(0.0), turn)) + 1e-6), "near-lists")
        first = ranking.top_n(by_list, ["query_id"], [F.desc("along_q"), F.col("list")], probes).drop("rank")
        found = staging.written(self._compared(first, members, None, k), "found")
        scanned = first.select("query_id", "list")
        if exact:
            kth = ranking.top_n(found, ["query_id"], [F.desc("similarity"), F.col("id")], k, "place").groupBy("query_id").agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("got"))
            rest = by_list.join(scanned, ["query_id", "list"], "left_anti").join(kth, "query_id", "left").filter((F.coalesce("got", F.lit(0)) < k) | (F.col("bound") >= F.col("kth")))
            rest = staging.written(rest, "rest-lists")
            found = found.unionByName(self._compared(rest.drop("kth", "got"), members, kth.filter(F.col("got") >= k), k))
            scanned = scanned.unionByName(rest.select("query_id", "list"))
        return ranking.top_n(found, ["query_id"], [F.desc("similarity"), F.col("id")], k, "place"), scanned

    def _compared(self, lists: DataFrame, members: DataFrame, kth: DataFrame | None, k: int) -> DataFrame:
        """query_id, chat_id, id, similarity of what may be among the k best in the lists (query_id, chat_id, q, list, along_q), compared by whole vectors.

        Queries and bytes of a list meet by blocks, and only what its block allows to be among the k best of a query leaves it.
        """
        asked = lists.select("query_id", "chat_id", "list", F.col("query_id").alias("l"), "q", "along_q", F.lit(None).cast("double").alias("kth"))
        if kth is not None:
            asked = asked.drop("kth").join(kth.select("query_id", "kth"), "query_id", "left")
        schema = f"query_id {lists.schema['query_id'].dataType.simpleString()}, chat_id string, id long, about double, error double"
        told = members.filter("error is not null").select("chat_id", "list", F.col("id").alias("r"), "code", "scale", "error")
        found = near.by_blocks(staging.written(asked, "asked-lists"), staging.written(told, "told-lists"), ["chat_id", "list"], _bytes_compared(k), schema, near.WIDE)
        rows = staging.written(found, "by-bytes")
        sure = ranking.top_n(rows.select("query_id", "id", (F.col("about") - F.col("error")).alias("low")), ["query_id"], [F.desc("low"), F.col("id")], k)
        floor = sure.groupBy("query_id").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("low")).alias("low"))
        if kth is not None:
            floor = floor.join(kth.select("query_id", "kth"), "query_id", "left").select("query_id", F.greatest("low", "kth").alias("low"))
        may = rows.join(floor, "query_id").filter(F.col("low").isNull() | (F.col("about") + F.col("error") >= F.col("low"))).select("query_id", "chat_id", "id")
        whole = may.join(self.full().select("chat_id", "id", "unit"), ["chat_id", "id"]).join(lists.select("query_id", "q").dropDuplicates(["query_id"]), "query_id")
        return whole.select("query_id", "chat_id", "id", vector.dot(F.col("unit"), F.col("q")).alias("similarity"))


def _bytes_compared(k: int):
    """For two blocks, queries and bytes of a list: query_id, chat_id, id, about (the likeness by bytes), error, of what can be among the k best of a query there and reach its ``kth``."""

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": x["query_id"].iloc[:0], "chat_id": x["chat_id"].iloc[:0], "id": y["r"].iloc[:0].to_numpy(), "about": np.empty(0), "error": np.empty(0)})]
        # a list's vectors are of one length, and a query of another length is like nothing there
        size = len(y["code"].iloc[0]) if len(y) else 0
        x = x[[len(q) == size for q in x["q"]]]
        if len(x) and len(y):
            codes = np.stack([np.asarray(c, dtype=np.float64) for c in y["code"]]).T * y["scale"].to_numpy()
            miss = y["error"].to_numpy() + 1e-6
            asked = np.stack([np.asarray(q, dtype=np.float64) for q in x["q"]])
            along, kth = x["along_q"].to_numpy(), x["kth"].astype("float64").to_numpy()
            for i in range(0, len(asked), near.STRIPE):
                about = asked[i : i + near.STRIPE] @ codes + along[i : i + near.STRIPE, None]
                least = np.nan_to_num(kth[i : i + near.STRIPE], nan=-np.inf)
                if about.shape[1] >= k:
                    least = np.maximum(least, np.partition(about - miss, -k, axis=1)[:, -k])
                at, to = np.nonzero(about + miss >= least[:, None])
                if len(at):
                    found.append(pd.DataFrame({"query_id": x["query_id"].to_numpy()[i + at], "chat_id": x["chat_id"].to_numpy()[i + at], "id": y["r"].to_numpy()[to], "about": about[at, to], "error": miss[to]}))
        return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    return compare
