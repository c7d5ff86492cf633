"""Token counts by merging against a tokenizer library."""

import base64

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallspark.functions import tokens

tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LINES = tokens.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in LINES)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_all_texts(spark, library):
    """Every text of the smallest documents, conversations and pages."""
    sf = "/root/testdata/sf0.001"
    for table, column in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
        rows = tokens.with_counts(spark.read.parquet(f"{sf}/{table}.parquet").select(column), column, LINES).collect()
        assert [r.n_tokens for r in rows] == [len(library.encode_ordinary(r[0] or "")) for r in rows]


def test_awkward_texts(spark, library):
    texts = [None, "", " ", "\n\n a", "a" * 3000, "ab" * 500, "日本語 текст é", "don't we'll", "x" * 255 + " " + "y" * 256, "123456 7", "<|endoftext|>", "🙂🙂‍"]
    rows = tokens.with_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text", LINES).orderBy("id").collect()
    assert [r.n_tokens for r in rows] == [len(library.encode_ordinary(t or "")) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=30), min_size=1, max_size=20))
def test_words_of_a_batch(library, words):
    assert MERGES.counts([w.encode() for w in words]).tolist() == [len(library._encode_single_piece(w.encode())) for w in words]


MERGES = tokens.Merges(LINES)
