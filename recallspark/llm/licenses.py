"""Licence scan: passages of a text compared to licence templates by the Dice coefficient over word bigrams.

A passage is a run of neighbouring sentences, whatever lines and paragraphs it spans. Dice = 2 c / (a + b)
for a passage of a bigrams, a template of b and c common ones. At a threshold t a template can only
match if t / (2 - t) <= a / b <= (2 - t) / t, which bounds the runs, and c >= t (a + b) / 2 bigrams
must be a template's, which rules out most starts of runs before any run is compared.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+(?=\S)")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")

MATCH = "array<struct<license:string,dice:double,start:int,end:int>>"


def words(text: str) -> list[str]:
    """Normalised words: lower case, punctuation dropped, British spelling of 'licence' made one with the other."""
    return [("license" + w[7:]) if w.startswith("licence") else w for w in _WORD.findall(text.lower())]


def bigrams(found: list[str]) -> Counter:
    return Counter(zip(found, found[1:]))


def dice(x: Counter, y: Counter) -> float:
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


class Scanner:
    """Templates sorted by size; ``threshold`` must be over 0."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        made = [(bigrams(words(text)), name) for name, text in templates]
        made = sorted(((sum(b.values()), name, b) for b, name in made if b), key=lambda x: x[:2])
        self.threshold, self.templates, self.sizes = threshold, made, [m[0] for m in made]
        self.vocabulary = {w for _, _, b in made for pair in b for w in pair}
        self.index: dict = {}
        for i, (_, _, b) in enumerate(made):
            for pair, n in b.items():
                self.index.setdefault(pair, []).append((i, n))
        self.ratio = threshold / (2 - threshold)
        self.least, self.most = (self.sizes[0] * self.ratio, self.sizes[-1] / self.ratio) if made else (1, 0)
        self.needed = max(1.0, self.least - 1e-9)

    def _may(self, size: int, known: int) -> bool:
        """Whether a passage of ``size`` words with ``known`` words of templates can match anything.

        A template it matches has at least ratio * a bigrams, so c >= t (1 + ratio) a / 2 = ratio * a, and c bigrams cover over c words.
        """
        a = size - 1
        return a >= self.least - 1e-9 and a <= self.most + 1e-9 and known >= self.ratio * a + 1 - 1e-9

    def best(self, passage: list[str]) -> tuple[str, float] | None:
        """The template of the greatest Dice, if that reaches the threshold; of equal ones the longest, then the first by name."""
        own, a, found = bigrams(passage), len(passage) - 1, None
        lo = bisect.bisect_left(self.sizes, a * self.ratio - 1e-9)
        hi = bisect.bisect_right(self.sizes, a / self.ratio + 1e-9)
        for size, name, template in self.templates[lo:hi]:
            value = 2 * sum((own & template).values()) / (a + size)
            if value >= self.threshold - 1e-12 and (found is None or (value, size) > found[:2]):
                found = (value, size, name)
        return (found[2], found[0]) if found else None

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of each line, in text order."""
        found, at = [], 0
        for a, b in [m.span() for m in _LINE.finditer(text)] + [(len(text), len(text))]:
            edge = at
            for s, e in [m.span() for m in _SENTENCE.finditer(text, at, a)]:
                found.append((edge, s))
                edge = e
            found.append((edge, a))
            at = b
        return found

    def _runs(self, pieces: list[list[str]]) -> list[tuple[int, float, int, str, int, int]]:
        """(c, Dice, b, licence, first piece, last piece) of every run of neighbouring pieces and every template that it matches.

        ``gain`` is the number of template bigrams less ratio for each bigram, summed from the start of the text. In a run that matches
        c >= ratio * a, so the gain isn't less at its end than at its start, and a start that no later end reaches is left out.
        """
        own = [w for piece in pieces for w in piece]
        pairs = list(zip(own, own[1:]))
        edges = np.cumsum([0] + [len(piece) for piece in pieces])
        gain = np.concatenate([[0.0], np.cumsum([p in self.index for p in pairs]) - self.ratio * np.arange(1, len(pairs) + 1)])
        starts, ends = edges[:-1], edges[1:]
        highest = np.maximum.accumulate(gain[ends - 1][::-1])[::-1]
        found = []
        for first in np.nonzero(highest >= gain[starts] - 1e-6)[0].tolist():
            start = int(starts[first])
            stop = int(np.searchsorted(ends, start + 1 + self.most + 1e-9, "right"))
            good = np.nonzero(gain[ends[first:stop] - 1] >= gain[start] - 1e-6)[0]
            at, seen, common_ = start, Counter(), [0] * len(self.templates)
            for last in (good + first).tolist():
                end = int(ends[last])
                for pair in pairs[at : end - 1]:
                    if pair in self.index:
                        seen[pair] += 1
                        for i, n in self.index[pair]:
                            common_[i] += seen[pair] <= n
                at, a = max(at, end - 1), end - 1 - start
                lo, hi = bisect.bisect_left(self.sizes, a * self.ratio - 1e-9), bisect.bisect_right(self.sizes, a / self.ratio + 1e-9)
                for i in range(lo, hi):
                    c, size = common_[i], self.sizes[i]
                    if c and (value := 2 * c / (a + size)) >= self.threshold - 1e-12:
                        found.append((c, value, size, self.templates[i][1], first, last))
        return found

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, start, end) of matching passages, in text order; no two overlap.

        A passage is any run of neighbouring sentences, over the ends of lines and paragraphs. For each template the run of the greatest Dice
        stands for those that overlap it. Of overlapping runs of different templates the one with most bigrams in common stays, so a passage
        inside a larger one that matches isn't reported; of equal ones the greater Dice, the longer template and the first by name.
        """
        own = words(text)
        if sum(map(self.index.__contains__, zip(own, own[1:]))) < self.needed:
            return []
        pieces = [(words(text[s:e]), s, e) for s, e in self._pieces(text)]
        pieces = [p for p in pieces if p[0]]
        runs, taken, chosen = self._runs([p[0] for p in pieces]), bytearray(len(pieces)), []
        while runs:
            marks: dict = {}
            standing = []
            for run in sorted(runs, key=lambda r: (-r[1], -r[0], r[4:])):
                mark = marks.setdefault(run[2:4], bytearray(len(pieces)))
                if not any(mark[run[4] : run[5] + 1]):
                    mark[run[4] : run[5] + 1] = b"\1" * (run[5] + 1 - run[4])
                    standing.append(run)
            for run in sorted(standing, key=lambda r: (-r[0], -r[1], -r[2], r[3:])):
                if not any(taken[run[4] : run[5] + 1]):
                    taken[run[4] : run[5] + 1] = b"\1" * (run[5] + 1 - run[4])
                    chosen.append(run)
            runs = [r for r in runs if not any(taken[r[4] : r[5] + 1])]
        return [(r[3], r[1], pieces[r[4]][1], pieces[r[5]][2]) for r in sorted(chosen, key=lambda r: r[4])]


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id and ``matches``, an array of (license, dice, start, end) in text order.

    Null and empty texts have an empty array. Rows that repeat a doc_id are scanned each for itself. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    entry = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(parts):
        scanner = Scanner(threshold=threshold)
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                rows = [
                    [dict(zip(("license", "dice", "start", "end"), m)) for m in scanner.scan(t or "")]
                    for t in part.column(1).slice(at, 1024).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, 1024), pa.array(rows, pa.list_(entry))], ["doc_id", "matches"])

    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, matches {MATCH}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
    )
