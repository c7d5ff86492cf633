"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from recallspark.plans import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables_of(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables():
    """The smallest tables, and the next larger ones for what has no rows in these."""
    return {folder: tables_of(folder) for folder in (SF, LARGER)}


def rows(df, columns):
    def plain(v):
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, tables, name):
    folder = SF
    expected = tables[folder].execute(registry.ORACLES[name]).fetchdf()
    if not len(expected):
        folder = LARGER
        expected = tables[folder].execute(registry.ORACLES[name]).fetchdf()
    found = registry.QUERIES[name](spark, folder).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns) and len(found)
    assert rows(found, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"trade_communities"}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_stream_and_plan_agree(spark):
    both = [registry.QUERIES[n](spark, SF).toPandas().sort_values(["chat_id", "batch"], ignore_index=True) for n in ("planned_batches", "streamed_batches")]
    pd.testing.assert_frame_equal(*both)


#: Queries with the column that tells an operator's decision, each outcome of which occurs at sf0.01.
OUTCOMES = {
    "reflection_verdicts": ("verdict", {"reject", "replace", "add"}), "skip_reflections": ("skip", {True, False}), "recalled": ("phase", {1, 2, 3}),
    "sentiment_moody": ("mood", {"positive", "negative", "neutral"}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_each_outcome_occurs(name):
    con = tables_of(LARGER)
    column, outcomes = OUTCOMES[name]
    counts = con.execute(registry.ORACLES[name]).fetchdf()[column].value_counts()
    assert set(counts.index) == outcomes and counts.min() >= 5


def test_what_a_fallback_or_a_filter_decides_occurs():
    """External hits fall back for some chats; of new events some repeat a stored one and some don't; some memories of a selection are contradicted."""
    con = tables_of(LARGER)
    hits = con.execute(registry.ORACLES["external_hits"]).fetchdf().similarity
    assert hits.isna().sum() >= 5 and hits.notna().sum() >= 5
    assert 5 <= len(con.execute(registry.ORACLES["against_store"]).fetchdf()) <= 1000 // 2 - 5
    from recallspark.plans import further

    given = con.execute(f"{further._RECALL} SELECT (SELECT count(*) FROM given), (SELECT count(*) FROM final)").fetchone()
    assert given[0] - given[1] >= 5
