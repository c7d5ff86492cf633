"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a fixed lexicon and of one learned from the labelled
rows that the trees are fitted on, how near the hits stand to the second person, capitals, punctuation and obfuscated spelling.
Spark's own trees and isotonic regression are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are fitted, at most: those with the smallest hash of their doc_id. A third of them calibrate.
TRAIN_ROWS = 8_000
#: Words of the learned lexicon, at most, and how many labelled toxic texts must have one.
LEARNED_WORDS, LEARNED_TEXTS = 1_000, 4
THRESHOLD = 0.3
#: Distinct tokens whose class a task remembers at a time.
MEMORY = 500_000

# Common insults and hostile words of everyday English, and second-person words of four languages.
LEXICON = frozenset(
    """arrogant ass bastard bitch brainless clown coward creep crook cretin damn degenerate despicable dimwit dirtbag disgrace
    disgusting dumb dumbass dummy failure filth filthy fool foolish fraud freak garbage gross gullible hate hateful horrible
    hypocrite idiot idiotic ignorant imbecile incompetent inferior insane jerk kill lame laughable liar loser losers lowlife
    lunatic maggot miserable moron moronic nasty nobody pathetic parasite pig pitiful psycho punk rat repulsive revolting
    rotten rubbish scum scumbag shameful shit shut sick simpleton slime snake spineless stupid suck sucks swine terrible thug
    traitor trash troll ugly useless vermin vile weak weirdo worthless wretch""".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu toi ton ta tes vous votre vos te ti tuyo usted ustedes su".split())
# Characters that stand for letters in obfuscated spelling.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})

FEATURES = [
    "words", "lexicon", "lexicon_log", "lexicon_kinds", "learned", "learned_log", "learned_kinds", "second_person", "near_second_person",
    "capitals", "shouted", "exclamations", "questions", "other_marks", "obfuscated", "obfuscated_hits", "stretched",
]
_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INNER = re.compile(r"[^\w]")
_STRETCH = re.compile(r"(.)\1\1")
_MARK = np.zeros(129, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point 2 if it is a capital letter, 1 if another letter, else 0."""
    return np.fromiter(((2 if c.isupper() else 1) if c.isalpha() else 0 for c in map(chr, range(0x110000))), np.uint8, 0x110000)


class Featurizer:
    """Dense features of whole texts; ``learned`` maps words to their log-odds of toxic texts."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.classes: dict[str, tuple[str, int, float, int, int, int, int]] = {}

    def _class(self, token: str):
        """(word, in lexicon, log-odds, second person, obfuscated, obfuscated hit, stretched) of a token."""
        word = _EDGES.sub("", token)
        odd = obfuscated = 0
        if word and not word.isalpha():
            plain = _INNER.sub("", word.translate(LOOKALIKES))
            odd = int(any(c.isalpha() for c in word) and len(plain) > 2)
            if odd and plain.isalpha() and (plain in LEXICON or plain in self.learned):
                word, obfuscated = plain, 1
        shrunk = int(bool(_STRETCH.search(word)))
        if shrunk and word not in LEXICON:
            short = re.sub(r"(.)\1\1+", r"\1", word)
            word = short if short in LEXICON else word
        return word, int(word in LEXICON), self.learned.get(word, 0.0), int(word in SECOND_PERSON), odd, obfuscated, shrunk

    def one(self, text: str) -> list[float]:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        tokens = text.lower().split()
        n = max(1, len(tokens))
        hits = weight = you = odd = hidden = stretched = 0.0
        kinds, learned_kinds, marked = set(), set(), False
        learned_hits = 0
        classes = self.classes
        for token, times in Counter(tokens).items():
            found = classes.get(token)
            if found is None:
                if len(classes) >= MEMORY:
                    classes.clear()
                found = self._class(token)
                if len(token) <= 64:
                    classes[token] = found
            word, lexicon, odds, second, strange, obfuscated, long = found
            if lexicon:
                hits += times
                kinds.add(word)
            if odds:
                weight += odds * times
                learned_hits += times
                learned_kinds.add(word)
            you += second * times
            odd += strange * times
            hidden += obfuscated * times
            stretched += long * times
        near = 0
        if (hits or learned_hits) and you:
            flags = [classes.get(t) or self._class(t) for t in tokens]
            seconds = np.flatnonzero([f[3] for f in flags])
            places = np.flatnonzero([f[1] or f[2] > 0 for f in flags])
            at = np.searchsorted(seconds, places)
            before = np.abs(places - seconds[np.maximum(at - 1, 0)])
            after = np.abs(places - seconds[np.minimum(at, len(seconds) - 1)])
            near = int((np.minimum(before, after) <= 5).sum())
        counts = np.bincount(np.minimum(codes, 128), minlength=129)  # of ASCII characters; all others are the last
        _, small, capital = np.bincount(_letters()[codes], minlength=3)
        letters = max(1, int(small + capital))
        shouted = sum(1 for t in text.split() if len(t) > 2 and t.isupper()) if capital > 0.2 * letters else 0
        marks = float(counts[_MARK].sum())
        size = max(1, len(codes))
        return [
            float(np.log1p(len(tokens))), 100 * hits / n, float(np.log1p(hits)), float(len(kinds)), 100 * weight / n, float(np.log1p(learned_hits)),
            float(len(learned_kinds)), 100 * you / n, near / max(1.0, hits + learned_hits), capital / letters, shouted / n,
            100.0 * counts[33] / size, 100.0 * counts[63] / size, 100 * (marks - counts[33] - counts[63]) / size, odd / n, hidden / n, stretched / n,
        ]


def featurize(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """doc_id and one double column for each of FEATURES; null text counts as empty. The other columns given are kept."""
    keep = [c for c in docs.columns if c != "text"]
    place = docs.columns.index("text")

    def run(parts):
        found = Featurizer(learned)
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                one = part.slice(at, 1024)
                rows = np.array([found.one(t or "") for t in one.column(place).to_pylist()]).reshape(-1, len(FEATURES))
                kept = [c for i, c in enumerate(one.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], [*keep, *FEATURES])

    kinds = dict(docs.dtypes)
    return common.map_arrow(docs, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in FEATURES)]))


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_words(train: DataFrame) -> dict[str, float]:
    """Words of toxic texts by the lower end of their log-odds: at most LEARNED_WORDS of them, over 1 each."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,40}"), 0)))
    sums = train.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, all_ = sums[0] or 0, sums[1]
    if not 0 < bad < all_:
        return {}
    per = train.select("toxic", words.alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    clean = F.col("n") - F.col("t")
    odds = F.log((F.col("t") + 0.5) / (bad - F.col("t") + 0.5)) - F.log((clean + 0.5) / (all_ - bad - clean + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (clean + 0.5))
    top = per.filter(F.col("t") >= LEARNED_TEXTS).select("word", (odds - 2 * spread).alias("low")).filter("low > 1")
    return {r["word"]: float(r["low"]) for r in top.orderBy(F.desc("low"), "word").limit(LEARNED_WORDS).collect()}


class ToxicityModel:
    """Learned words, trees and calibration; ``trees`` is None where the labels don't have both values."""

    def __init__(self, learned, trees, isotonic, base):
        self.learned, self.trees, self.isotonic, self.base = learned, trees, isotonic, base


def _vectors(table: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features_vector").transform(table)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled documents that aren't held out: the bound on what is learned from.

    A document with several labels counts as toxic if one of them says so; null labels and ids are left out. Rows of ``docs`` that
    repeat a labelled doc_id are learned from each for itself. Words of the learned lexicon are bounded by LEARNED_WORDS, of 3 to 40 letters.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    picked = F.broadcast(rows.orderBy("order", "doc_id").limit(train_rows))  # at most train_rows small rows
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("doc_id", "toxic", "order", "text")
    train = common.materialize(train, "toxic-train")
    part = F.pmod("order", F.lit(3))
    learned = learn_words(train.filter(part > 0))  # the rows that calibrate are unseen by words and trees
    table = common.materialize(featurize(train.select("toxic", "order", "text"), learned), "toxic-features")
    table = _vectors(table).withColumn("label", F.col("toxic").cast("double"))
    fitted, calibration = table.filter(part > 0), table.filter(part == 0)
    counts = table.agg(*(F.count(F.when(c, 1)) for c in (part > 0, (part > 0) & (F.col("toxic") == 1), part == 0)), F.avg("label")).first()
    if not 0 < counts[1] < counts[0] or not counts[2]:
        return ToxicityModel(learned, None, None, float(counts[3] or 0.0))
    trees = GBTClassifier(
        featuresCol="features_vector", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=1
    ).fit(fitted.coalesce(2))
    margin = vector_to_array("probability")[1]
    scored = trees.transform(calibration).select("label", margin.alias("p"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(scored.coalesce(1))
    return ToxicityModel(learned, trees, isotonic, float(counts[3]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row for each document: doc_id, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Very long texts are scored whole, rows that repeat a doc_id each for itself. Null and empty texts are scored like a text without words. Where nothing could be learned all
    documents get the share of toxic labels (0 without labels). The calibrated score is a step function; a
    hundredth of the trees' own probability is mixed in so that texts on one step stay ordered. Other columns are ignored.
    """
    table = featurize(docs.select("doc_id", "text"), model.learned)
    if model.trees is None:
        value = F.lit(model.base)
    else:
        table = model.trees.transform(_vectors(table)).withColumn("p", vector_to_array("probability")[1])
        table = model.isotonic.transform(table)
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("p")))
    table = table.select("doc_id", value.alias("score"))
    return table.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
