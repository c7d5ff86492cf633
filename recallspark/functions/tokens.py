"""Token counts by byte-pair merging.

Texts are cut into words by the vocabulary's pattern, and each distinct word of a batch is merged once. All words of a batch are merged together: in every
step each word joins its pair of the lowest rank, the first of several, until no word has a pair that the vocabulary knows.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_code

#: Distinct words that are merged together at most, and letters of a word from which on it is merged by itself.
WORDS, LONG = 20_000, 256
#: Fixed value: the pattern that cuts texts into words for byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1) << 40


class Merges:
    """The pairs of a vocabulary in rank form (base64 of a token's bytes and its rank on each line) as sorted arrays."""

    def __init__(self, lines):
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, and with it the token that it becomes; _NONE where the vocabulary doesn't know it."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each word is."""
        sizes = np.array([len(w) for w in words], np.int64)
        done = sizes.copy()
        tokens = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(tokens) > 1:
            inner = word[1:] == word[:-1]
            rank = np.append(np.where(inner, self._rank(tokens[:-1], tokens[1:]), _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, ~inner))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(tokens)))
            hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank < _NONE))
            if not len(hit):
                break
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]  # the first of each word
            tokens[hit] = rank[hit]
            kept = np.ones(len(tokens), bool)
            kept[hit + 1] = False
            done[word[hit]] -= 1
            moving = np.repeat(least < _NONE, size)  # words without a pair are done
            tokens, word = tokens[kept & moving], word[kept & moving]
        return done


def with_counts(df: DataFrame, column: str, vocabulary: list[str], out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text column, null counting as empty, by the lines of a vocabulary in rank form.

    The vocabulary is sent to the tasks once. A batch's distinct words are merged once each, whatever texts they stand in.
    """
    spark = df.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    state = {}

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd
        import regex

        if "merges" not in state:
            state["merges"], state["pattern"] = Merges(sent.value), regex.compile(PATTERN)
        found = [Counter(state["pattern"].findall(t)) if t else {} for t in texts]
        distinct = sorted({w for c in found for w in c}, key=len)
        n: dict[str, int] = {}
        first = 0
        while first < len(distinct):
            step = WORDS if len(distinct[first]) < LONG else 1
            words = distinct[first : first + step]
            n.update(zip(words, state["merges"].counts([w.encode() for w in words]).tolist(), strict=True))
            first += step
        return pd.Series([sum(n[w] * k for w, k in c.items()) for c in found], dtype="int64")

    return df.withColumn(out, count(F.col(column)))


def read_vocabulary(path: str) -> list[str]:
    """The lines of a vocabulary file."""
    with open(path, encoding="ascii") as lines:
        return lines.read().splitlines()
