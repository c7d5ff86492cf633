"""The registered queries: against their SQL, and the pipeline stage by stage."""

import hashlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from recallspark.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns) and len(found) == len(expected)
    key = sorted(found.columns)

    def rows(df):
        return sorted(
            repr([None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6) for v in r]) for r in df[key].astype(object).itertuples(index=False)
        )

    assert rows(found) == rows(expected)


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
        ids = {r.doc_id for r in out.collect()}
        assert ids <= set(before), name
        if name == "exact dedup":
            assert len(ids) == len({hashlib.sha256(" ".join(t.split()).encode()).digest() for t in before.values()})
        if name in ("language ID", "packing"):
            assert ids == set(before)
        docs = out
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)


def run_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    return docs


def test_pipeline_on_awkward_rows(spark):
    """Null, repeated and clashing ids, null and empty texts, copies of all kinds, extra columns that clash with the stages' own names."""
    long = " ".join(f"word{i}" for i in range(3000))
    near = long.replace("word77 ", "other ")
    rows = [
        (1, long, "en", "a"), (2, long.replace(" ", "  "), "en", "a"), (3, near, "en", "b"), (None, "a text without an id", "en", "b"), (None, "a text without an id", "en", "b"), (None, None, None, None),
        (5, "", "en", "a"), (6, "123 !!", "en", "a"), (7, "first text of seven", "en", None), (7, "second text of seven", "en", None), (7, "second text of seven", "en", None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id long, band long, rep long, key binary, size int, target double, shard int, piece int, c long"
    docs = spark.createDataFrame([(*r, 1, True, 1, 1, 1, b"x", 1, 1.0, 1, 1, 1) for r in rows], schema)
    seen, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, SF).collect(), schema)
        assert seen.columns == docs.columns, name
        left.append(sorted((r.doc_id or 0, " ".join(r.text.split())[:10]) for r in seen.collect()))
    told, exact, near_, mixed = left
    assert len(told) == 8 and (5, "") not in told and all(i != 6 for i, _ in told)
    assert exact == [(0, "a text wit"), (1, "word0 word"), (3, "word0 word"), (7, "first text"), (7, "second tex")]
    assert near_ == [(0, "a text wit"), (1, "word0 word"), (7, "first text"), (7, "second tex")]
    assert set(mixed) <= set(near_) and mixed
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert {r.doc_id for r in packed} == {i or None for i, _ in mixed} and all(0 < r.length <= 2048 for r in packed)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert run_stages(spark, docs).count() == 0
