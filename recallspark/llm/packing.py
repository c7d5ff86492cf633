"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Documents are tokenised in Arrow batches; only those longer than a sequence are
cut, so that all pieces but the first are full. Pieces are dealt to shards of
bounded size, and each shard packs its pieces by itself. An open sequence with
gap ``g`` counts in ``N[g]``; a piece goes where the sum of all ``N[g]^2`` becomes
smallest, taking the smaller gap on a tie. Sequences that stay loosely filled are packed again by the same rule.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Pieces of a shard: packed by one task.
SHARD = 16384
#: Tasks that pack, at most; more shards share them.
MAX_TASKS = 100_000
#: Sequences with at least this share of the capacity left are packed once more.
LOOSE = 1 / 32


@functools.cache
def _exact(name: str):
    """The tokenizer of a file."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def _ranks(name: str):
    """The vocabulary of a file as ranks, where it also comes in that form."""
    if name != "byte_bpe_50k.json":
        return None
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, name: str = TOKENIZER) -> bytes:
    """Ids of a whole text, as the tokenizer file gives them without added special tokens: little-endian unsigned 32-bit.

    Where the same vocabulary also comes as ranks these encode the text, which is several times as fast; they don't know the special
    token, so a text in which it may occur takes the file. Either is loaded only where it is needed.
    """
    plain = _ranks(name)
    if plain is None or "<|" in text:
        return np.array(_exact(name).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return np.array(plain.encode_ordinary(text), "<u4").tobytes()


def _piecer(name: str, capacity: int):
    def pieces(parts):
        end = np.array([END], "<u4").tobytes()
        for part in parts:
            for at in range(0, part.num_rows, 256):
                ids, texts = part.column(0).slice(at, 256), part.column(1).slice(at, 256).to_pylist()
                rows, number, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts):
                    data = token_ids(text or "", name) + end
                    n = len(data) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                        rows.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(data[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return pieces


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.iinfo(np.int64).max
    where, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        if size == capacity:
            where[i], offset[i], used = used, 0, used + 1
            continue
        # Moving a sequence from gap g = size + h to gap h changes the sum by 2 (N[h] - N[g] + 1); a full one (h = 0)
        # leaves the sum, so it changes by 1 - 2 N[g]; a new one changes it by 1 + 2 N[capacity - size].
        there = count[size:capacity]
        change = 2 - 2 * there
        change[1:] += 2 * count[1 : capacity - size]
        change[0] -= 1
        change[there == 0] = never
        best = int(np.argmin(change))
        if change[best] <= 1 + 2 * count[capacity - size] and change[best] < never:
            gap = size + best
            bin_ = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_, used = capacity, used, used + 1
        where[i], offset[i] = bin_, capacity - gap
        left = gap - size
        if left:
            open_[left].append(bin_)
            count[left] += 1
    return where, offset


def pack_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares, longest pieces first; what its loosely filled sequences hold is then packed again by the same rule.

    The rule keeps sequences of many gaps open for pieces to come. When none come any more these are its loss, and
    packing their pieces anew, among themselves, closes most of them. That is repeated as long as it saves sequences.
    """
    where, offset = sum_of_squares(lengths, capacity)
    while len(where):
        filled = np.bincount(where, weights=lengths)
        loose = (capacity - filled >= capacity * LOOSE) & (filled > 0)
        again = loose[where]
        where2, offset2 = sum_of_squares(lengths[again], capacity)
        if not len(where2) or where2.max() + 1 >= loose.sum():
            break
        where[again], offset[again] = np.flatnonzero(loose)[where2], offset2
    return where, offset


def _packer(capacity: int):
    def pack(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, offset = pack_pieces(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["shard"].astype("int64") * (1 << 32) + where, offset=offset)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; null text counts as empty and gives that id alone.
    Very long texts are cut into many pieces. Rows that repeat a doc_id are packed each for itself. Null doc_ids are packed too.
    Shards are dealt by a hash of the piece, so no document or source decides a shard's size. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = common.materialize(common.map_arrow(docs.select("doc_id", "text"), _piecer(tokenizer, capacity), columns), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32), {shards}) as int)"))
    # one shard for each task: sizes of small rows would put many shards into one
    dealt = dealt.repartitionById(min(shards, MAX_TASKS), "shard")
    packed = dealt.groupBy("shard").applyInPandas(_packer(capacity), f"{columns}, shard int, sequence_id long, offset long")
    return packed.drop("shard")


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read_table(spark, sf_dir, "documents"))
