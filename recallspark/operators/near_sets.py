"""Pairs of sets of words with a high Jaccard similarity, by blocks: exact, and nothing is shuffled for a pair that can't be alike."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import staging
from ..shipping import ship_code
from .near import by_blocks

#: Bands of sizes from that of a set to that of the largest set that can be like it.
STEPS = 3
#: Rows of a block; bits of a signature at most; numbers that are unpacked for a product at once.
BLOCK, MOST_BITS, CELLS = 16384, 1 << 16, 1 << 22
#: Sets of a block whose words are compared, and ids of such sets that are sent to every task.
WORDY, MAX_SENT = 4096, 300_000


def _band(size: Column, at_least: float) -> Column:
    """The logarithm of a size, STEPS apart for the sizes of which one is ``at_least`` of the other."""
    return F.ln(size) / F.lit(max(-math.log(at_least), 0.05) / STEPS)


def _bits(band: int, at_least: float) -> int:
    """Bits of a band's signatures, by its largest size: so many that the words in which unrelated sets differ seldom fall on one bit."""
    largest, apart = math.exp((band + 1) * max(-math.log(at_least), 0.05) / STEPS), (1 - at_least) / (1 + at_least)
    return min(MOST_BITS, 1 << math.ceil(math.log2(100 + largest / (1 - apart) ** 2.4)))


def _signatures(side: DataFrame, name: str, at_least: float) -> DataFrame:
    """chat_id, name, n, band, bits: of each set its size and the parities of how many words fall on each bit."""
    words = F.col(f"{name}_words")
    rows = side.filter(F.size(words) > 0).select("chat_id", name, F.size(words).alias("n"), F.floor(_band(F.size(words), at_least)).cast("int").alias("band"), F.transform(words, lambda w: F.xxhash64(w)).alias("bits"))

    def parities(batches):
        for batch in batches:
            lists = batch.column("bits")
            n, band = lists.value_lengths().to_numpy(), batch.column("band").to_numpy()
            start, hashes = np.cumsum(n) - n, lists.flatten().to_numpy().view(np.uint64)
            found = np.empty(len(n), dtype=object)
            for one in np.unique(band):
                width = _bits(int(one), at_least)
                at, step = np.flatnonzero(band == one), max(1, CELLS // width)
                for i in range(0, len(at), step):
                    some = at[i : i + step]
                    place = np.repeat(np.arange(len(some)), n[some])
                    word = hashes[np.repeat(start[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(len(place))]
                    odd = np.bincount(place * width + (word & np.uint64(width - 1)).astype(np.int64), minlength=len(some) * width) & 1
                    found[some] = [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(len(some), width), axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=batch.schema.names)

    return rows.mapInArrow(parities, StructType([*rows.schema.fields[:-1]]).add("bits", "binary"))


def _folded(column: pd.Series, size: int) -> np.ndarray:
    """Signatures of ``size`` bytes: halves of longer ones are laid over each other, which makes the signature that the set has with fewer bits."""
    found, sizes = np.empty((len(column), size), dtype=np.uint8), np.array([len(x) for x in column])
    for one in np.unique(sizes):
        x = np.frombuffer(b"".join(column[sizes == one]), dtype=np.uint8).reshape(-1, one)
        while x.shape[1] > size:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        found[sizes == one] = x
    return found


def _signs(bits: np.ndarray, *more) -> np.ndarray:
    """Bits as 1 and -1, and further columns."""
    rows = np.empty((len(bits), bits.shape[1] * 8 + len(more)), dtype=np.float32)
    rows[:, : bits.shape[1] * 8] = np.unpackbits(bits, axis=1)
    rows[:, : bits.shape[1] * 8] *= 2
    rows[:, : bits.shape[1] * 8] -= 1
    for i, column in enumerate(more):
        rows[:, bits.shape[1] * 8 + i] = column
    return rows


def key_candidates(one: DataFrame, two: DataFrame | None, at_least: float) -> DataFrame:
    """chat_id, l, r: pairs of word sets (chat_id, l, l_words; chat_id, r, r_words) that may have a Jaccard similarity of ``at_least``; without ``two`` pairs l < r of one table.

    Sets of n and m words that are similar differ in (1 - t) / (1 + t) (n + m) words at most. Each word in which they differ changes one bit of their signatures, so these differ in
    no more bits; unrelated sets nearly always do. How many bits differ comes from a product of matrices for each pair of blocks of a chat and of sizes that fit, which gives on only what may be
    similar. So the products grow with the square of a chat, but what is shuffled is a signature once for each block that it meets.
    """
    ship_code(one.sparkSession)
    t = max(at_least, 1e-6)
    apart, alone = (1 - t) / (1 + t), two is None
    left = staging.written(_signatures(one, "l", t), "signatures")
    right = (left if alone else staging.written(_signatures(two, "r", t), "signatures")).toDF("chat_id", "r", "n", "band", "bits")
    # sets of the same table meet in the band of the smaller one
    low, high = (F.floor(_band(F.col("n"), t) + x).cast("int") for x in (-STEPS - 1e-6, STEPS + 1e-6))
    bands = F.sequence(F.greatest(low, F.lit(0)), F.col("band") if alone else high)
    right = right.select("chat_id", "r", F.col("n").alias("m"), F.col("band").alias("own"), F.col("bits").alias("bits2"), F.explode(bands).alias("band"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [x.iloc[:0][["chat_id", "l"]].assign(r=y["r"].iloc[:0].to_numpy())]
        if len(x) and len(y):
            size = min(min(map(len, x["bits"])), min(map(len, y["bits2"])))
            p, q, step = _folded(x["bits"], size), _folded(y["bits2"], size), max(64, min(2048, CELLS // (8 * size)))
            n, m = (2 * apart * z.to_numpy(np.float32) for z in (x["n"], y["m"]))
            ls, rs, same = x["l"].to_numpy(), y["r"].to_numpy(), y["own"].to_numpy() == x["band"].iloc[0]
            for j in range(0, len(q), step):
                b = _signs(q[j : j + step], 1, m[j : j + step]).T
                for i in range(0, len(p), step):
                    # bits less twice those that differ, and twice the words that may
                    at, to = np.nonzero(_signs(p[i : i + step], n[i : i + step], 1) @ b >= 8 * size - 0.5)
                    l, r, both = ls[i + at], rs[j + to], same[j + to]
                    if alone:
                        kept = ~both | (l < r)
                        at, l, r = at[kept], l[kept], r[kept]
                        l, r = np.where(l < r, l, r), np.where(l < r, r, l)
                    if len(at):
                        found.append(pd.DataFrame({"chat_id": x["chat_id"].to_numpy()[i + at], "l": l, "r": r}))
        return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    schema = StructType([left.schema["chat_id"], left.schema["l"], right.schema["r"]])
    return by_blocks(left, right, ["chat_id", "band"], compare, schema, BLOCK)


def jaccards(met: DataFrame, one: DataFrame, two: DataFrame, at_least: float) -> DataFrame:
    """chat_id, l, r, similarity of the pairs ``met`` (chat_id, l, r) whose word sets have a Jaccard similarity of ``at_least`` and a word in common.

    The sets that are in some pair meet by blocks of a chat, so their words are shuffled once for each block of the other side and not for each pair.
    """
    ship_code(met.sparkSession)

    def asked(side: DataFrame, name: str) -> DataFrame:
        return side.join(staging.small(met.select("chat_id", name).distinct(), MAX_SENT), ["chat_id", name], "left_semi")

    others = met.groupBy("chat_id", "l").agg(F.collect_set("r").alias("rs"))
    left, right = staging.written(asked(one, "l").join(others, ["chat_id", "l"]), "alike-left"), staging.written(asked(two, "r"), "alike-right")

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        sets, others, given = x["l_words"].combine_chunks(), x["rs"].combine_chunks(), y["r_words"].combine_chunks()
        said = pa.chunked_array([sets.flatten(), given.flatten()]).combine_chunks().dictionary_encode()
        words, marked = said.indices.to_numpy(), np.zeros(len(said.dictionary), dtype=bool)
        n, m, k = (z.value_lengths().to_numpy() for z in (sets, given, others))
        begin, start = np.cumsum(n) - n, n.sum() + np.cumsum(m) - m
        # rows of the right side by id, of which each may be there more than once or not at all
        ids = y["r"].to_numpy()
        order = np.argsort(ids, kind="stable")
        asked_ids = others.flatten().to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(ids[order], asked_ids, side) for side in ("left", "right"))
        last = np.cumsum(k)
        ats, tos, found = [], [], []
        for at in np.flatnonzero(k):
            a, b = low[last[at] - k[at] : last[at]], high[last[at] - k[at] : last[at]]
            rows = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            if not len(rows):
                continue
            rows = order[rows]
            own = words[begin[at] : begin[at] + n[at]]
            marked[own] = True
            step = max(1, CELLS // int(m[rows].max()))
            for to in (rows[i : i + step] for i in range(0, len(rows), step)):
                ends = np.cumsum(m[to])
                place = np.repeat(start[to] - (ends - m[to]), m[to]) + np.arange(ends[-1])
                both = np.add.reduceat(marked[words[place]].astype(np.int64), ends - m[to])
                similarity = both / (n[at] + m[to] - both)
                kept = (similarity >= at_least) & (both > 0)
                ats.append(np.full(kept.sum(), at))
                tos.append(to[kept])
                found.append(similarity[kept])
            marked[own] = False
        at, to = (pa.array(np.concatenate([np.empty(0, dtype=np.int64), *z])) for z in (ats, tos))
        return pa.table({"chat_id": x["chat_id"].take(at), "l": x["l"].take(at), "r": y["r"].take(to), "similarity": np.concatenate([np.empty(0), *found])})

    schema = StructType([met.schema["chat_id"], left.schema["l"], right.schema["r"]]).add("similarity", "double")
    return by_blocks(left, right, ["chat_id"], compare, schema, WORDY, arrow=True)
