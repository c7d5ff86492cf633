"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text for each language accepts exactly the
substrings of that text. A document is parsed greedily: each phrase is the longest
match from where the last one ended, and a symbol that occurs nowhere is a
phrase of its own. The language that needs the fewest phrases for each symbol wins.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of labelled text in the automaton of a language: the bound on what is fitted.
TRAIN_CHARS = 24_000
#: Symbols of a stretch; the stretches of all texts are parsed side by side and then joined, so that they make no difference.
STRETCH = 512
#: Characters that a task parses at a time.
PORTION = 1 << 20
UNDETERMINED = "und"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _portions(texts: list[str | None], limit: int = PORTION):
    """(indexes, texts) of about ``limit`` characters; a text is never divided."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        if text:
            owners.append(i)
            parts.append(text)
            size += len(text)
        if size >= limit:
            yield np.array(owners), parts
            owners, parts, size = [], [], 0
    if parts:
        yield np.array(owners), parts


class Moves:
    """Transitions of all automata in one double array: state q moves by symbol c to ``to[base[q] + c]`` if ``owner[base[q] + c]`` is q, else nowhere.

    The rows of states are laid over each other so that no two moves fall on one place; the room taken is about that of the
    moves themselves, however large the alphabet is.
    """

    def __init__(self, rows: list[dict[int, int]], width: int):
        n = sum(map(len, rows))
        self.base = np.zeros(len(rows), np.int64)
        free = np.ones(n + width + 1, bool)
        self.owner = np.full(len(free), -1, np.int32)
        self.to = np.full(len(free), -1, np.int32)
        low = 0
        for q in sorted((q for q, row in enumerate(rows) if len(row) > 1), key=lambda q: (-len(rows[q]), q)):
            symbols = np.fromiter(rows[q], np.int64, len(rows[q]))
            base = self._fit(free, symbols, low, width)
            if base + width >= len(free):
                more = len(free) + width
                free = np.concatenate([free, np.ones(more, bool)])
                self.owner, self.to = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (self.owner, self.to))
            self._set(free, q, base, symbols, rows[q])
            while not free[low]:
                low += 1
        # a single move goes to any free place; places come first by number
        single = [q for q, row in enumerate(rows) if len(row) == 1]
        short = width + len(single) - int(free[width:].sum())
        if short > 0:
            free = np.concatenate([free, np.ones(short, bool)])
            self.owner, self.to = (np.concatenate([x, np.full(short, -1, np.int32)]) for x in (self.owner, self.to))
        for q, place in zip(single, (width + np.flatnonzero(free[width:])).tolist()):
            ((c, to),) = rows[q].items()
            self.base[q], self.owner[place], self.to[place] = place - c, q, to
        pad = np.full(width, -1, np.int32)
        self.owner, self.to = np.concatenate([self.owner, pad]), np.concatenate([self.to, pad])

    @staticmethod
    def _fit(free: np.ndarray, symbols: np.ndarray, low: int, width: int) -> int:
        """The first base from ``low`` - width on, 0 at least, at which all places of the symbols are free."""
        at = max(0, low - width)
        while True:
            stop = min(len(free) - width, at + 4096)
            if stop <= at:
                return max(at, len(free) - 1)
            fits = free[at + symbols[0] : stop + symbols[0]].copy()
            for c in symbols[1:]:
                fits &= free[at + c : stop + c]
            found = int(fits.argmax())
            if fits[found]:
                return at + found
            at = stop

    def _set(self, free, q, base, symbols, row):
        self.base[q] = base
        free[base + symbols] = False
        self.owner[base + symbols] = q
        self.to[base + symbols] = np.fromiter(row.values(), np.int64, len(row))

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        place = self.base.take(state) + symbol
        return np.where(self.owner.take(place) == state, self.to.take(place), -1)


class LanguageModel:
    """The automata of all languages, their moves in one array.

    Symbol 0 stands for a stretch of anything but letters, the last symbol for letters that no
    training text has. ``roots`` holds the root of each language, in the order of ``languages``.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.alphabet = sorted({c for t in texts.values() for c in t.lower() if c.isalpha() and len(c) == 1})
        self._names()
        rows, self.roots = [], []
        for language in self.languages:
            at = len(rows)
            self.roots.append(at)
            rows += [{c: to + at for c, to in out.items()} for out in suffix_automaton(self.symbols(texts[language]).tolist())]
        rows.append({})  # a last state without moves: a symbol that no phrase can start with ends its phrase
        self.dead = len(rows) - 1
        self.moves = Moves(rows, len(self.alphabet) + 2)

    def _names(self) -> None:
        """Symbols of code points."""
        names = np.where(_letters(), len(self.alphabet) + 1, 0).astype(np.uint16)
        for i, c in enumerate(self.alphabet):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    names[ord(form)] = i + 1
        self.names = names

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "names"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._names()

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text: letters in lower case, other stretches as one symbol, none at the ends."""
        found = self.names[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = found > 0
        keep[1:] |= found[:-1] > 0
        found = found[keep]
        return found[:-1] if len(found) and found[-1] == 0 else found

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases[text, language], symbols of each text).

        Stretches of all texts are first parsed side by side as if a phrase began at each stretch. Then the phrase that is
        open at a stretch's end goes on into the next one until a phrase ends where one of that stretch's own does;
        from there on both parses are the same. Where that never happens the stretch's end changes, and the next one is gone over again.
        """
        k, n_texts = len(self.languages), len(texts)
        parsed = [self.symbols(t) for t in texts]
        sizes = np.array([len(x) for x in parsed], np.int64)
        owner = np.repeat(np.arange(n_texts), -(-sizes // STRETCH))
        pieces = [x[a : a + STRETCH] for x in parsed for a in range(0, len(x), STRETCH)]
        m = len(pieces)
        lengths = np.array([len(x) for x in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        column = np.argsort(order)  # of each piece
        grid = np.zeros((STRETCH, m), np.int64)
        for j, i in enumerate(order):
            grid[: lengths[i], j] = pieces[i]
        alive = np.searchsorted(-lengths[order], -np.arange(STRETCH), side="left")  # columns longer than t
        roots = np.array(self.roots, np.int64)
        width = len(self.alphabet) + 2
        first = self.moves(np.repeat(roots, width), np.tile(np.arange(width), k)).reshape(k, width).astype(np.int64)
        first[first < 0] = self.dead
        state = np.repeat(roots[:, None], m, axis=1)
        starts = np.zeros((STRETCH, k, m), bool)  # where a phrase of a stretch's own parse begins
        for t in range(STRETCH):
            n = alive[t]
            if not n:
                break
            s = grid[t, :n]
            to = self.moves(state[:, :n], s)
            lost = to < 0
            starts[t, :, :n] = lost if t else True
            state[:, :n] = np.where(lost, first[:, s], to)
        counts = starts.sum(axis=0)
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # pieces that go on with the text of the one before
        lang, piece = np.repeat(np.arange(k), len(follows)), np.tile(follows, k)
        entered = np.full((k, m), -1, np.int64)  # the state that a piece was gone into with
        while len(piece):
            here, before = column[piece], column[piece - 1]
            enter = state[lang, before]
            entered[lang, here] = enter
            now, new, going = enter.copy(), np.zeros(len(piece), np.int64), np.arange(len(piece))
            for t in range(STRETCH):
                inside = lengths[piece[going]] > t
                going = going[inside]
                if not len(going):
                    break
                g, h = lang[going], here[going]
                s = grid[t, h]
                to = self.moves(now[going], s)
                lost = to < 0
                new[going] += lost
                now[going] = np.where(lost, first[g, s], to)
                met = lost & starts[t, g, h]
                done = going[met]
                new[done] += starts[t + 1 :, lang[done], here[done]].sum(axis=0)
                now[done] = -1
                going = going[~met]
            counts[lang, here] = new
            # pieces whose own parse was never met end in another state than thought
            open_ = now >= 0
            state[lang[open_], here[open_]] = now[open_]
            after = piece + 1
            again = open_ & (after < m)
            again[again] = owner[after[again]] == owner[piece[again]]
            again[again] = entered[lang[again], column[after[again]]] != now[again]
            lang, piece = lang[again], after[again]
        total = np.zeros((k, n_texts), np.int64)
        for language in range(k):
            total[language] = np.bincount(owner, weights=counts[language, column], minlength=n_texts)
        return total.T, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text.

        The score is how much fewer phrases the best language needs than the next one, as a share of the latter's.
        With one language it is the share of symbols that phrases save. Ties go to the language first by name.
        """
        best, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return best, score
        counts, sizes = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for owners, parts in _portions(texts):
            found, length = self.phrases(parts)
            np.add.at(counts, owners, found)
            np.add.at(sizes, owners, length)
        for i in np.flatnonzero(sizes):
            by = counts[i]
            w = int(np.argmin(by))
            others = np.delete(by, w)
            other = int(others.min()) if len(others) else int(sizes[i])
            best[i], score[i] = self.languages[w], float(max(0.0, 1 - by[w] / max(1, other)))
        return best, score


def held_out(doc_id, fold: int = 5):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by ``fold``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold == 0


def fit(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> LanguageModel:
    """A model of the labelled documents that aren't held out.

    The bound: for each language distinct texts of at most a quarter of ``train_chars`` characters, in the
    order of a hash of the text, until ``train_chars`` are reached. Only about twice that leaves
    the executors for each language, whatever the number of rows and copies. A language with long texts only is fitted on the start of its shortest one.
    """
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0)).select("lang", "text")
    rows = rows.withColumn("n", F.length("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("u", F.expr("shiftrightunsigned(h, 11) / 9007199254740992D")).withColumn("short", F.col("n") <= train_chars // 4)
    # copies of a text meet in each task before they are shuffled, and count once
    texts_ = rows.groupBy("lang", "h").agg(F.first("n").alias("n"), F.first("short").alias("short"))
    totals = texts_.groupBy("lang").agg(F.sum(F.when(F.col("short"), F.col("n"))).alias("total")).collect()
    if not totals:
        return LanguageModel({})
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * train_chars / r["total"])) for r in totals if r["total"]], "lang string, p double")
    picked = rows.filter("short").join(F.broadcast(share), "lang").filter("u < p").groupBy("lang", "h").agg(F.min(F.struct("u", "text")).alias("t"))
    texts: dict[str, list[str]] = {r["lang"]: [] for r in totals}
    size = dict.fromkeys(texts, 0)
    for r in sorted(picked.collect(), key=lambda r: (r["t"]["u"], r["t"]["text"])):
        if size[r["lang"]] < train_chars:
            texts[r["lang"]].append(r["t"]["text"])
            size[r["lang"]] += len(r["t"]["text"])
    without = [x for x in texts if not texts[x]]
    if without:
        starts = rows.filter(F.col("lang").isin(without)).groupBy("lang").agg(F.min(F.struct("n", "u", F.substring("text", 1, train_chars).alias("start"))).alias("t"))
        for r in starts.collect():
            texts[r["lang"]] = [r["t"]["start"]]
    return LanguageModel({lang: "\n".join(found) for lang, found in texts.items()})


def _predictor(model):
    def predict(parts):
        found = model.value
        for part in parts:
            for at in range(0, part.num_rows, 512):
                ids, texts = part.column(0).slice(at, 512), part.column(1).slice(at, 512).to_pylist()
                lang, score = found.predict(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score, from the whole text only.

    Texts of any length are parsed whole. ``und`` with score 0 for a null text, for one without letters, and where nothing was learned. Rows
    that repeat a doc_id are predicted each for itself. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_CHARS for each language
    return common.map_arrow(docs.select("doc_id", "text"), _predictor(shared), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told, with all their columns, decided row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))
    place = docs.columns.index("text")

    def keep(parts):
        for part in parts:
            lang, _ = shared.value.predict(part.column(place).to_pylist())
            yield part.filter(pa.array([x != UNDETERMINED for x in lang], pa.bool_()))

    return common.map_arrow(docs, keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
