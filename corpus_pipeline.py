"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallspark.llm import common, exact_dedup, language, mixing, near_dedup, packing


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (4): documents whose language can't be told go."""
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (10): one document of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (6): one document of each group of near duplicates, linked from a similarity of 0.8 on, stays."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (5): whole documents, as often as the schedule takes their first word, so that sources meet their target weights."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (2): the pieces of the documents and their places in sequences of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", tell_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Language ID and packing need models that SQL doesn't have; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again.

    Documents with null or empty text, or without letters, go with the first stage, as their language can't be told. Texts that are equal but for white
    space leave one row, also where doc_ids are null or repeated; rows with a null doc_id are documents like others. Long texts are taken whole and cut only when they are packed.
    A null source is a source of its own. A document that the mix repeats is packed as often. An empty table gives no rows, and columns beyond those of
    documents, whatever their names, go through all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
