"""Tables of the store: Parquet by chat, JSON export and import, migrations and a vector index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..functions import codec
from ..operators import maintenance

PRIVATE = ["embedding", "tokens", "message_fingerprints", "st_synced"]
VERSION = 4


def save(table: DataFrame, folder: str, name: str, expected_chat: str | None = None) -> None:
    """Write a table by chat; chats that the rows don't name stay as they are.

    With ``expected_chat`` rows of any other chat are refused before anything is written, as when the chat was left while its tables were made.
    """
    if expected_chat is not None and not table.filter(~F.col("chat_id").eqNullSafe(expected_chat)).isEmpty():
        raise ValueError(f"rows of another chat than {expected_chat!r}")
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_id").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, chat_id: str | None = None) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}")
    return table if chat_id is None else table.filter(F.col("chat_id") == chat_id)


def export_json(table: DataFrame) -> DataFrame:
    """Rows as JSON text without vectors and other fields that only this store understands."""
    kept = table.drop(*[c for c in PRIVATE if c in table.columns])
    return kept.select("chat_id", F.to_json(F.struct(*[c for c in kept.columns if c != "chat_id"]), {"ignoreNullFields": "true"}).alias("value"))


def strip_fields(value: Column, fields: list[str] = PRIVATE) -> Column:
    """JSON text without the given fields at any depth."""
    return codec.strip_json(value, F.array(*[F.lit(f) for f in fields]))


def write_export(table: DataFrame, path: str) -> None:
    """The export as text files by chat, a row on each line."""
    export_json(table).write.mode("overwrite").partitionBy("chat_id").text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("chat_id").cast("string").alias("chat_id"), "value")


def check_import(payload: Column, marker: str = "_export") -> Column:
    """What is wrong with an export as one JSON text, or null.

    It must be an object with a true field named ``marker``, hold an array of memories with id and summary each, and name the nodes of its graph.
    """
    read = F.from_json(payload, "memories array<struct<id:string,summary:string>>, graph struct<nodes:map<string,struct<name:string>>>")
    mark = F.coalesce(F.get_json_object(payload, f"$.{marker}"), F.lit("false"))
    nodes = F.map_values(F.coalesce(read["graph"]["nodes"], F.create_map().cast("map<string,struct<name:string>>")))

    def blank(text: Column) -> Column:
        return F.length(F.coalesce(text, F.lit(""))) == 0

    return (
        F.when(F.get_json_object(payload, "$").isNull() | ~F.trim(payload).startswith("{"), "no JSON object")
        .when(mark.isin("false", "0", "", "null"), "not an export")
        .when(read["memories"].isNull(), "no memories")
        .when(F.exists(read["memories"], lambda m: blank(m["id"]) | blank(m["summary"])), "a memory without id or summary")
        .when(F.exists(nodes, lambda n: blank(n["name"])), "a node without a name")
    )


def import_json(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of exported JSON (chat_id, value); lines that aren't valid, or lack an id or a summary, are marked by ``problem``."""
    parsed = lines.select("chat_id", "value", F.from_json("value", schema).alias("r")).select("chat_id", "value", "r.*")
    problem = F.when(F.col("id").isNull(), "no id").when(F.length(F.coalesce("summary", F.lit(""))) == 0, "no summary")
    return parsed.withColumn("problem", problem)


def merge_import(stored: DataFrame, imported: DataFrame, strategy: str = "merge") -> DataFrame:
    """Imported rows without a problem are added where their id is new. With ``replace`` they stand for all that the chats they name had."""
    good = imported.filter(F.col("problem").isNull()).drop("problem", "value").dropDuplicates(["chat_id", "id"])
    if strategy == "replace":
        return stored.join(good.select("chat_id").distinct(), "chat_id", "left_anti").unionByName(good, allowMissingColumns=True)
    return maintenance.union_first(stored, good)


def backfill_clock(memories: DataFrame, clock: DataFrame) -> DataFrame:
    """Version 4: extraction_count from the sequence, else the first messages, else the chat's clock; never beyond that clock."""
    rows = memories.join(clock.select("chat_id", F.col("count").alias("__now")), "chat_id", "left")
    now = F.coalesce("__now", F.lit(0))
    of = F.when(F.col("type") == "reflection", now).when(F.col("sequence") > 0, F.floor(F.col("sequence") / 1000)).when(F.size("message_ids") > 0, F.array_max("message_ids")).otherwise(now)
    value = F.greatest(F.lit(0), F.least(of, now)).cast("long")
    return rows.withColumn("extraction_count", F.coalesce("extraction_count", value)).drop("__now")


def backfill_fingerprints(memories: DataFrame, messages: DataFrame) -> DataFrame:
    """Version 3: fingerprints of the message ids that exist, in their order."""
    ids = memories.select("chat_id", "id", F.posexplode("message_ids").alias("p", "idx")).join(messages.select("chat_id", "idx", "fingerprint"), ["chat_id", "idx"])
    lists = ids.groupBy("chat_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "fingerprint"))), lambda x: x["fingerprint"]).alias("message_fingerprints"))
    return memories.drop("message_fingerprints").join(lists, ["chat_id", "id"], "left")


def processed_fingerprints(done_ids: DataFrame, messages: DataFrame, memories: DataFrame) -> DataFrame:
    """Version 2: processed message ids (chat_id, idx) as fingerprints; messages sent after the last memory were not processed."""
    sent = parse_send_date(F.col("send_date"))
    last = memories.groupBy("chat_id").agg(F.max("created_at").alias("last"))
    rows = messages.withColumn("sent", sent).join(done_ids, ["chat_id", "idx"], "left_semi").join(last, "chat_id")
    return rows.filter(F.col("sent") <= F.col("last")).select("chat_id", "fingerprint").distinct()


def drop_foreign_vectors(table: DataFrame, headers: DataFrame, model: str) -> DataFrame:
    """Vectors of chats (chat_id, model) that another model made are dropped."""
    rows = table.join(headers.select("chat_id", F.col("model").alias("__m")), "chat_id", "left")
    return rows.withColumn("embedding", F.when(F.col("__m") == model, F.col("embedding"))).drop("__m")


def parse_send_date(send_date: Column) -> Column:
    """Milliseconds: digits are taken as they are, other texts are read as a date, and what is neither is 0."""
    return F.when(send_date.rlike(r"^\d+$"), send_date.cast("long")).otherwise(F.coalesce(F.unix_millis(F.try_to_timestamp(send_date)), F.lit(0)))


def encode_vectors(table: DataFrame) -> DataFrame:
    """Version 2: vectors stored as arrays become base64 texts."""
    return table.withColumn("embedding", codec.encode_vector("embedding"))


def migrate(memories: DataFrame, version: int, messages: DataFrame, clock: DataFrame, done_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(memories, processed fingerprints) after all steps from ``version`` to the current one, in order.

    Before version 2 vectors are arrays and processed messages (``done_ids``: chat_id, idx) are named by place; both are rewritten. From
    version 2 on the processed fingerprints are kept elsewhere, and None is returned for them.
    """
    prints = None
    if version < 2:
        if done_ids is not None:
            prints = processed_fingerprints(done_ids, messages, memories)
        if "embedding" in memories.columns and memories.schema["embedding"].dataType.typeName() == "array":
            memories = encode_vectors(memories)
    if version < 3:
        memories = backfill_fingerprints(memories, messages)
    if version < VERSION:
        memories = backfill_clock(memories, clock)
    return memories, prints


class VectorIndex:
    """One Parquet table of vectors (chat_id, id, embedding) by chat: insert, delete, purge; search is ``scoring.nearest``.

    A change rewrites the chats that it touches and no others. The state is in the folder alone, so an index can be opened
    again, by several readers. Each chat keeps a row without an id, so that one whose vectors are all gone still has a file to be written.
    """

    FIELDS = "id long, embedding array<float>, chat_id string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.FIELDS).parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.FIELDS)

    def read(self, chat_id: str | None = None) -> DataFrame:
        table = self._all().filter(F.col("id").isNotNull()).select("chat_id", "id", "embedding")
        return table if chat_id is None else table.filter(F.col("chat_id") == chat_id)

    def _put(self, rows: DataFrame, chats: DataFrame) -> None:
        marks = chats.select("chat_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<float>").alias("embedding"))
        table = staging.cut(rows.unionByName(marks).repartition("chat_id"))  # read in full before the files it came from are replaced
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_id").parquet(self.folder)

    def insert(self, rows: DataFrame) -> None:
        """Add rows; an id that is there already is replaced."""
        rows = staging.cut(rows.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))
        chats = rows.select("chat_id").distinct()
        kept = self.read().join(chats, "chat_id", "left_semi").join(rows, ["chat_id", "id"], "left_anti")
        self._put(kept.unionByName(rows), chats)

    def delete(self, ids: DataFrame) -> None:
        """Remove vectors by chat and id; ids that aren't there don't matter."""
        ids = staging.cut(ids.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("id").cast("long").alias("id")))
        chats = ids.select("chat_id").distinct()
        self._put(self.read().join(chats, "chat_id", "left_semi").join(ids, ["chat_id", "id"], "left_anti"), chats)

    def purge(self, chat_id: str) -> None:
        self._put(self.read(chat_id).limit(0), self.spark.createDataFrame([(chat_id,)], "chat_id string"))

    def apply(self, changes: DataFrame) -> None:
        """A change set (chat_id, id, embedding, op): ``sync`` rows are inserted, ``delete`` rows removed, deletions last."""
        changes = staging.cut(changes)
        self.insert(changes.filter("op = 'sync'").drop("op"))
        self.delete(changes.filter("op = 'delete'"))
