"""Corpus statistics that are kept: document frequencies, sizes and lengths as signed differences of each batch of changes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical

SCHEMA = "chat_id string, term string, n long, length long"


class Statistics:
    """Differences below ``folder``, a part for each batch: of a term (n: documents with it), and where the term is null of a chat (n: documents, length: all terms).

    Batches can be applied in any order. One that is applied again replaces what it wrote, so a batch that failed half-way is simply repeated. Reading adds the batches up;
    ``compact`` writes the sums as one batch of a new folder. No batch reads the corpus, only what it changes.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def apply(self, batch: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Memories (as they are or tokenized) that came in and that went. A changed memory is removed as it was and added as it is; an archived one is removed."""
        parts = [lexical.told(d).select("chat_id", "tokens", "dl", F.lit(s).alias("sign")) for d, s in ((added, 1), (removed, -1)) if d is not None]
        if not parts:
            return
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # a memory's size travels as a null among its terms, so that one pass and one shuffle make both
        each = rows.select("chat_id", "sign", F.col("dl").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
        length = F.sum(F.when(F.col("term").isNull(), F.col("sign") * F.col("dl")).otherwise(0))
        sums = each.groupBy("chat_id", "term").agg(F.sum("sign").cast("long").alias("n"), length.cast("long").alias("length"))
        sums.filter("n != 0 or length != 0").write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def sums(self) -> DataFrame:
        """chat_id, term, n, length, added up; nothing where no batch was applied."""
        try:
            table = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/batch=*")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            table = self.spark.createDataFrame([], SCHEMA)
        return table.groupBy("chat_id", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n != 0")

    def compact(self, folder: str) -> Statistics:
        """The same statistics as one batch, 0, of another folder. Batches that come later must have other numbers."""
        self.sums().write.mode("overwrite").parquet(f"{folder}/batch=0")
        return Statistics(self.spark, folder)

    def corpus(self) -> DataFrame:
        """chat_id, n_docs, avg_dl, as ``lexical.corpus_size`` gives it."""
        return self.sums().filter("term is null").select("chat_id", F.col("n").alias("n_docs"), (F.col("length") / F.col("n")).alias("avg_dl"))

    def idf(self) -> DataFrame:
        """chat_id, term, df, idf, as ``lexical.idf_table`` gives it."""
        sums = self.sums().filter("term is not null").select("chat_id", "term", F.col("n").alias("df"))
        return lexical.with_idf(sums, self.corpus())

    def vocabulary(self) -> DataFrame:
        return self.sums().filter("term is not null").select("chat_id", "term")
