"""Document fingerprints by consistent weighted sampling.

Terms are words (A-Z lower-cased) and pairs of neighbouring words, weighted by
how often they occur. For each of ``SAMPLES`` samples a term of weight w draws r, c from Gamma(2, 1) and
b from Uniform(0, 1), all fixed by the term's 64-bit hash and the sample. With t = floor(ln w / r + b) the term's value is
ln c - r (t - b) - r, and the sample is (term, t) of the smallest value. Two
texts share a sample with a probability equal to the generalised Jaccard similarity
of their weights, sum of minima over sum of maxima.

The three draws come from three unit exponentials x, y, z: c = x + y, r = ln(c / x) + z and b = 1 - ln(c / x) / r.
The ratio x / c is uniform and independent of c, so its negative logarithm is a unit exponential; hence r is Gamma(2, 1), the
share of it is uniform, and all three are independent. At weight 1, where t = 0, the value is then ln x, so
terms that occur once need one draw, and y and z are drawn only for terms that occur more often.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textvec

SAMPLES = 64
#: Terms that are drawn for at a time: the draws of a block stay in the processor's cache.
BLOCK = 512
_KEYS = np.random.Generator(np.random.PCG64(90210)).integers(0, 1 << 64, (3, SAMPLES, 1), dtype=np.uint64)


def _bits(terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64 hashed bits of each sample (rows) and term."""
    x = terms[None, :] ^ keys
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Uniform numbers strictly between 0 and 1, ascending with the bits."""
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def weighted_terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a text from the hashes of its words; terms are 64-bit hashes in ascending order."""
    pairs = textvec.mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return np.unique(np.concatenate([words, pairs]), return_counts=True)


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, c, r and b of each sample (rows) and term."""
    x = -np.log1p(-_uniform(_bits(terms, _KEYS[0])))
    y, z = (-np.log(_uniform(_bits(terms, k))) for k in _KEYS[1:])
    c = x + y
    part = np.log(c / x)
    r = part + z
    return x, c, r, 1 - part / r


def sample(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The samples of weighted terms, each as 32 bits; all ones for a text without terms. Ties go to the smaller term, which has next to no chance."""
    if not len(terms):
        return np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    row = np.arange(SAMPLES)
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    term, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    once = terms[weights == 1]
    for a in range(0, len(once), BLOCK):
        own = once[a : a + BLOCK]
        bits = _bits(own, _KEYS[0])
        at = bits.argmin(axis=1)
        found = bits[row, at]
        better = found < least
        least, term = np.where(better, found, least), np.where(better, own[at], term)
    best = np.log(-np.log1p(-_uniform(least))) if len(once) else np.full(SAMPLES, np.inf)
    more, heavy = terms[weights > 1], np.log(weights[weights > 1])
    for a in range(0, len(more), BLOCK):
        own = more[a : a + BLOCK]
        _, c, r, b = draws(own)
        t = np.floor(heavy[None, a : a + BLOCK] / r + b)
        value = np.log(c) - r * (t - b) - r
        at = value.argmin(axis=1)
        found = value[row, at]
        better = found < best
        best, term = np.where(better, found, best), np.where(better, own[at], term)
        level = np.where(better, t[row, at].astype(np.int64), level)
    return (textvec.mix64(term + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Samples of each text of a column, as rows."""
    out = np.empty((len(texts), SAMPLES), np.uint32)
    data, offsets = textvec.buffers(texts)
    for a, b in textvec.batches(data, offsets):
        own = offsets[a : b + 1]
        hashes, counts = textvec.word_hashes(data[own[0] : own[-1]], own - own[0])
        ends = np.cumsum(counts)
        for i in range(b - a):
            out[a + i] = sample(*weighted_terms(hashes[ends[i] - counts[i] : ends[i]]))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return (x == y).mean(axis=1)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal, 8 digits a sample) of each document; null text counts as empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts):
        for part in parts:
            rows = [x.tobytes().hex() for x in fingerprints(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.string())], ["doc_id", "fingerprint"])

    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint string")


_ROW = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ROW_SQL = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(texts: list[str], following: list[str], own: np.ndarray, other: np.ndarray) -> list[pa.Array]:
    new = [edited(x, y) for x, y in zip(texts, following)]
    changed = fingerprints(pa.array(new, pa.large_string()))
    columns = [
        [len(x) for x in texts],
        [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in new],
        [x.tobytes() for x in own],
        [x.tobytes() for x in changed],
        likeness(own, changed),
        likeness(own, other),
    ]
    return [pa.array(c, t) for c, (_, t) in zip(columns, _ROW)]


def _in_order(parts):
    """Rows of one range in order: all but the last are compared with their successor.

    The range's first text and last text are passed on as rows that only bear a text.
    """
    where = TaskContext.get().partitionId()
    names = ["doc_id", *[n for n, _ in _ROW], "role", "range", "text"]
    held = None  # (doc_id array of 1, text, fingerprint)

    def edge(ids, role, text):
        empty = [pa.nulls(1, t) for _, t in _ROW]
        return pa.RecordBatch.from_arrays([ids, *empty, pa.array([role]), pa.array([where], pa.int64()), pa.array([text], pa.string())], names)

    for part in parts:
        for at in range(0, part.num_rows, 512):
            ids, column = part.column(0).slice(at, 512), part.column(1).slice(at, 512)
            texts, prints = [x or "" for x in column.to_pylist()], fingerprints(column)
            if held is None:
                yield edge(ids.slice(0, 1), "first", texts[0])
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, prints = [held[1], *texts], np.concatenate([held[2], prints])
            m = len(texts) - 1
            if m:
                full = _compare(texts[:-1], texts[1:], prints[:-1], prints[1:])
                yield pa.RecordBatch.from_arrays([ids.slice(0, m), *full, pa.array(["row"] * m), pa.array([where] * m, pa.int64()), pa.nulls(m, pa.string())], names)
            held = ids.slice(m, 1), texts[-1], prints[-1:]
    if held is not None:
        yield edge(held[0], "last", held[1])


def _at_edges(parts):
    for part in parts:
        for at in range(0, part.num_rows, 512):
            one = part.slice(at, 512)
            texts, following = one.column(1).to_pylist(), one.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [one.column(0), *_compare(texts, following, fingerprints(one.column(1)), fingerprints(one.column(2)))], ["doc_id", *[n for n, _ in _ROW]]
            )


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next greater doc_id, and after the last
    comes the first. Documents are range-partitioned by doc_id, so that a text moves once; only
    the two texts at the ends of a range move again. Null texts count as empty: they have no terms, share
    all samples with each other and none with other texts. Null doc_ids come first and
    equal ones are ordered by text. A single document is its own next. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = common.map_arrow(ordered, _in_order, f"doc_id {kind}, {_ROW_SQL}, role string, range long, text string")
    rows = common.materialize(rows, "fingerprints")
    first = rows.filter("role = 'first'").select("range", F.col("text").alias("next_text"))
    ranges = first.select(
        F.col("range").alias("r"),
        F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())).alias("range"),
    )
    last = rows.filter("role = 'last'").select("doc_id", "text", F.col("range").alias("r"))
    edges = last.join(ranges, "r").join(first, "range").select("doc_id", "text", "next_text")
    edges = common.map_arrow(edges, _at_edges, f"doc_id {kind}, {_ROW_SQL}")
    found = rows.filter("role = 'row'").select(edges.columns).unionByName(edges)
    # the table between holds bytes; hexadecimal digits, which take twice the room, are made at the end
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(common.read_table(spark, sf_dir, "documents"))
