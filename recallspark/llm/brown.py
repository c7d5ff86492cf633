"""Language-model scores of texts by a class-based bigram model, as Brown and others describe it.

A word's probability after another is that of its class after the other's class, times its share of its class; classes come from exchange
clustering. Texts are tokenized once into blocks of local codes; everything later counts or scores blocks with numpy, and Spark adds up and joins what
blocks have found. Classes are made in three steps, each from counts over all training texts:

1. the most frequent words (``SEEDS``) are exchanged between classes, one at a time, as long as the likelihood of their bigrams grows;
2. the further frequent words (``FREQUENT``) move to the class that their neighbours among the first make likeliest;
3. so does every other word, by its frequent neighbours; these words are never gathered, but shuffled by their hash.

Words are told apart by a 64-bit hash; among a billion words two share one with a chance of 3 %, and would then count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

#: Classes; words that are exchanged; words whose class is sent to every task (less than 2 MB in all).
CLASSES, SEEDS, FREQUENT = 32, 1024, 65_535
#: Stands for words that aren't frequent where ranks are kept in two bytes.
NO_RANK = 65_535
#: Sweeps of the exchange at most.
SWEEPS = 20
#: Tokens of a block, but for a longer document, which is a block of its own at most.
BLOCK_TOKENS = 3 << 17
#: Blocks that a Python worker gets at a time, each of about a megabyte.
BLOCKS_AT_A_TIME = 4
#: Share of the plain unigram in a word's probability, and weight of the classes' own shares in their transitions.
UNIGRAM, SMOOTHING = 0.1, 10.0
#: The end of a text, which also stands before its first word.
END = np.uint64(0)


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


# ---- blocks


def _encode(parts):
    import pyarrow as pa

    ids, held, texts, sizes, tokens = [], [], [], [], 0

    def block(ids, held, texts, sizes):
        words, codes = np.unique(np.concatenate(texts), return_inverse=True)
        codes = codes.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        lengths = np.concatenate(sizes).astype(np.int32)
        told = pa.concat_arrays(ids)
        ends = pa.array([0, len(told)], pa.int32())
        columns = [pa.ListArray.from_arrays(ends, x) for x in (told, pa.concat_arrays(held), pa.array(lengths))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([words.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["ids", "held", "lengths", "words", "codes"])

    for part in parts:
        data, offsets = textvec.buffers(part.column(2))
        for a, b in textvec.batches(data, offsets):
            own = offsets[a : b + 1]
            hashes, counts = textvec.word_hashes(data[own[0] : own[-1]], own - own[0])
            counts = counts + 1
            ends = np.zeros(len(hashes) + len(counts), bool)
            ends[np.cumsum(counts) - 1] = True
            all_ = np.full(len(ends), END, np.uint64)
            all_[~ends] = hashes
            ids.append(pa.concat_arrays([part.column(0).slice(a, b - a)]))
            held.append(pa.concat_arrays([part.column(1).slice(a, b - a)]))
            texts.append(all_)
            sizes.append(counts)
            tokens += len(all_)
            if tokens >= BLOCK_TOKENS:
                yield block(ids, held, texts, sizes)
                ids, held, texts, sizes, tokens = [], [], [], [], 0
    if texts:
        yield block(ids, held, texts, sizes)


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents, written: block, ids, held, lengths (in tokens, the end included), words (sorted 64-bit hashes), codes (each token's place among them)."""
    kind = dict(docs.dtypes)["doc_id"]
    told = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = f"ids array<{kind}>, held array<boolean>, lengths array<int>, words binary, codes binary"
    return common.materialize(common.map_arrow(told, _encode, schema).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


class _Block:
    """A row of the blocks' table."""

    def __init__(self, part, i: int):
        self.ids, self.held_out = part.column("ids")[i].values, part.column("held")[i].values
        self.lengths = part.column("lengths")[i].values.to_numpy()
        self.words = np.frombuffer(part.column("words")[i].as_buffer(), np.uint64)
        codes = np.frombuffer(part.column("codes")[i].as_buffer(), np.uint16 if len(self.words) <= 1 << 16 else np.uint32)
        self.codes = codes.astype(np.int64)

    def learned(self) -> np.ndarray:
        """Which tokens are learned from."""
        return np.repeat(~self.held_out.to_numpy(zero_copy_only=False), self.lengths)


def _each(parts):
    for part in parts:
        for i in range(part.num_rows):
            yield part, i, _Block(part, i)


def _before(values: np.ndarray, end) -> np.ndarray:
    """The value of the token before; a document's first token comes after an end, as the document before it in the block has one."""
    return np.concatenate([np.array([end], values.dtype), values[:-1]])


def _batch(names: list[str], *columns: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _map(blocks: DataFrame, function, schema: str) -> DataFrame:
    return common.map_arrow(blocks.select("block", "ids", "held", "lengths", "words", "codes"), function, schema)


def vocabulary(blocks: DataFrame) -> DataFrame:
    """id, n: how often each word, and the end, occurs in the texts that are learned from; written."""

    def count(parts):
        for _, _, b in _each(parts):
            n = np.bincount(b.codes[b.learned()], minlength=len(b.words))
            yield _batch(["id", "n"], b.words[n > 0].view(np.int64), n[n > 0])

    with common.rows_at_a_time(blocks.sparkSession, BLOCKS_AT_A_TIME):
        return common.materialize(_map(blocks, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "lm-vocabulary")


# ---- classes


class Frequent:
    """The most frequent words by rank, the end first: their hashes and counts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.n, order = n, np.argsort(ids)
        self.sorted, self.rank = ids[order], order

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.rank[at], -1)


def frequent_words(vocab: DataFrame, limit: int) -> tuple[Frequent, int, int]:
    """(the ``limit`` most frequent words, all learned tokens, all learned words).

    A power of two that leaves a few times ``limit`` words comes before the sort, so that no task passes on more than it must.
    """
    powers = [F.count(F.when(F.col("n") >= 1 << i, 1)).alias(f"p{i}") for i in range(48)]
    told = vocab.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"), F.max(F.when(F.col("id") == 0, F.col("n"))).alias("ends"), *powers).first()
    least = max((1 << i for i in range(48) if told[f"p{i}"] >= limit), default=1)
    top = vocab.filter((F.col("id") != 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "id").limit(limit - 1).toPandas()
    ids = np.concatenate([[END], top["id"].to_numpy(np.int64).view(np.uint64)]).astype(np.uint64)
    return Frequent(ids, np.concatenate([[told["ends"] or 0], top["n"].to_numpy(np.int64)])), told["tokens"] or 0, told["words"]


def seed_bigrams(blocks: DataFrame, frequent: Frequent, seeds: int) -> np.ndarray:
    """How often each of the first ``seeds`` words follows each of them, as a matrix of fixed size."""

    def count(parts):
        pairs = np.zeros(seeds * seeds, np.int64)
        for _, _, b in _each(parts):
            w = frequent.ranks(b.words)[b.codes]
            v = _before(w, 0)
            own = b.learned() & (w >= 0) & (w < seeds) & (v >= 0) & (v < seeds)
            pairs += np.bincount(v[own] * seeds + w[own], minlength=seeds * seeds)
        at = np.flatnonzero(pairs)
        yield _batch(["v", "w", "n"], (at // seeds).astype(np.int32), (at % seeds).astype(np.int32), pairs[at])

    pairs = _map(blocks, count, "v int, w int, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
    found = np.zeros((seeds, seeds), np.int64)
    with common.rows_at_a_time(blocks.sparkSession, BLOCKS_AT_A_TIME):
        for row in pairs.groupBy("v").agg(F.collect_list("w").alias("w"), F.collect_list("n").alias("n")).toLocalIterator():
            found[row.v, row.w] = row.n
    return found


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word: words move one at a time, the most frequent first, to the class that gives their bigrams the greatest likelihood, until none moves."""
    size = len(bigrams)
    of = np.arange(size) % classes
    member = np.eye(classes, dtype=np.int64)[of]
    table = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(size):
            own = bigrams[w, w]
            into, out = bigrams[:, w] @ member, bigrams[w] @ member  # from each class to the word, and from it to each class
            a = of[w]
            into[a] -= own
            out[a] -= own
            table[:, a] -= into
            table[a] -= out
            table[a, a] -= own
            # what leads to the word and from it counts for the other classes wherever the word is
            rows, columns, kept = table.sum(axis=1) + into, table.sum(axis=0) + out, _xlogx(table)
            to, from_ = _xlogx(table + into[:, None]) - kept, _xlogx(table.T + out[:, None]).T - kept
            both = table.diagonal() + into + out + own
            gain = to.sum(axis=0) - to.diagonal() + from_.sum(axis=1) - from_.diagonal() + _xlogx(both) - kept.diagonal()
            n_in, n_out = into.sum() + own, out.sum() + own
            gain = gain - (_xlogx(rows + n_out) - _xlogx(rows)) - (_xlogx(columns + n_in) - _xlogx(columns))
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            table[:, best] += into
            table[best] += out
            table[best, best] += own
            if best != a:
                member[w, a], member[w, best], of[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return of


def affinities(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): what a neighbour of class l before a word, or r after it, adds to the log likelihood that the word is of each class. A last row of zeros stands for other neighbours."""
    rows, columns = table.sum(axis=1) + 1.0, table.sum(axis=0) + 1.0
    share = columns / columns.sum()
    step = np.log((table + SMOOTHING * share) / (rows + SMOOTHING)[:, None])
    left, right = step - np.log(columns), step.T
    return tuple(np.vstack([x, np.zeros(x.shape[1])]) for x in (left, right))


def _likeliest(parts, left: np.ndarray, right: np.ndarray):
    """id, n, class, seen of words with ``seen``, their neighbours' classes (l * (classes + 1) + r) and counts."""
    import pyarrow as pa

    others = left.shape[1] + 1
    for part in parts:
        seen = part.column("seen")
        flat, starts = seen.flatten(), seen.offsets.to_numpy()[:-1] - seen.offsets[0].as_py()
        lr, n = flat.field("lr").to_numpy().astype(np.int64), flat.field("n").to_numpy()
        found = np.zeros((len(starts), left.shape[1]))
        for k in range(left.shape[1]):
            found[:, k] = np.add.reduceat(n * (left[lr // others, k] + right[lr % others, k]), starts)
        total = np.add.reduceat(n, starts)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total), pa.array(np.argmax(found, axis=1).astype(np.int32)), seen], ["id", "n", "class", "seen"])


def classify(seen: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """id, n, class, seen of words by their neighbours (id, lr, n), of which a word has at most (classes + 1)^2 different ones once they are added up."""
    by_word = seen.repartition("id").groupBy("id", "lr").agg(F.sum("n").alias("n")).groupBy("id").agg(F.collect_list(F.struct("lr", "n")).alias("seen"))
    return common.map_arrow(by_word, lambda parts: _likeliest(parts, left, right), "id long, n long, class int, seen array<struct<lr: int, n: long>>")


def frequent_neighbours(blocks: DataFrame, frequent: Frequent, of: np.ndarray, seeds: int, classes: int) -> DataFrame:
    """id (the rank), lr, n: the classes beside each frequent word that isn't a seed, where these are seeds; one side at a time."""
    size, other = len(frequent.n), classes + 1
    class_of = np.full(size + 1, classes, np.int64)
    class_of[:seeds] = of

    def count(parts):
        sums = np.zeros((size - seeds) * 2 * classes, np.int32)
        for _, _, b in _each(parts):
            w = frequent.ranks(b.words)[b.codes]
            near = class_of[w]
            learned = b.learned() & (w >= seeds)
            after = np.concatenate([near[1:], [classes]])
            for side, beside in ((0, _before(near, class_of[0])), (1, after)):
                own = learned & (beside < classes)
                np.add.at(sums, ((w[own] - seeds) * 2 + side) * classes + beside[own], 1)
        found = np.flatnonzero(sums)
        for first in range(0, len(found), 1 << 17):
            at = found[first : first + (1 << 17)]
            side, beside = at // classes % 2, at % classes
            lr = np.where(side == 0, beside * other + classes, classes * other + beside)
            yield _batch(["id", "lr", "n"], at // (2 * classes) + seeds, lr.astype(np.int32), sums[at].astype(np.int64))

    return _map(blocks, count, "id long, lr int, n long")


def rare_neighbours(blocks: DataFrame, frequent: Frequent, of: np.ndarray, classes: int) -> DataFrame:
    """id, lr, n: the classes beside each occurrence of each word that isn't frequent; ``classes`` stands for another such word."""
    other, class_of = classes + 1, np.append(of, classes)

    def count(parts):
        for _, _, b in _each(parts):
            rank = frequent.ranks(b.words)
            near = class_of[rank[b.codes]]
            own = b.learned() & (rank[b.codes] < 0)
            lr = _before(near, class_of[0]) * other + np.concatenate([near[1:], [classes]])
            key, n = np.unique(b.codes[own] * (other * other) + lr[own], return_counts=True)
            yield _batch(["id", "lr", "n"], b.words[key // (other * other)].view(np.int64), (key % (other * other)).astype(np.int32), n)

    return _map(blocks, count, "id long, lr int, n long")


def frequent_transitions(blocks: DataFrame, frequent: Frequent, of: np.ndarray, classes: int) -> np.ndarray:
    class_of = np.append(of, classes)

    def count(parts):
        pairs = np.zeros((classes + 1) ** 2, np.int64)
        for _, _, b in _each(parts):
            near, own = class_of[frequent.ranks(b.words)][b.codes], b.learned()
            pairs += np.bincount(_before(near, class_of[0])[own] * (classes + 1) + near[own], minlength=len(pairs))
        yield _batch(["lr", "n"], np.arange(len(pairs), dtype=np.int32), pairs)

    found = np.zeros((classes + 1) ** 2)
    with common.rows_at_a_time(blocks.sparkSession, BLOCKS_AT_A_TIME):
        for row in _map(blocks, count, "lr int, n long").groupBy("lr").agg(F.sum("n").alias("n")).collect():
            found[row.lr] = row.n
    return found.reshape(classes + 1, classes + 1)[:classes, :classes]


# ---- the model


@dataclass
class Model:
    """Counts and classes: ``frequent`` words with their classes ``of``, all others as the table ``rare`` (id, n, class), and what the classes give.

    ``step[l, k]``: probability of class k after class l; row ``classes`` stands for a word before that was never learned. ``new[l]``: probability of such a word
    after class l. ``size[k]``: learned tokens of a class.
    """

    frequent: Frequent
    of: np.ndarray
    rare: DataFrame
    tokens: int
    words: int
    size: np.ndarray
    step: np.ndarray
    new: np.ndarray

    def log10(self, before: np.ndarray, now: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of words of class ``now`` with count ``n`` (0: never learned; all such words count as one) after words of class ``before``. Over all words these sum to 1."""
        if not self.tokens:
            return np.zeros(len(n))
        known = (1 - UNIGRAM) * self.step[before, np.minimum(now, len(self.size) - 1)] * n / self.size[np.minimum(now, len(self.size) - 1)] + UNIGRAM * n / self.tokens
        return np.log10(np.where(n > 0, (1 - self.new[before]) * known, self.new[before]))


def fit(blocks: DataFrame, classes: int = CLASSES, seeds: int = SEEDS, frequent_limit: int = FREQUENT) -> Model:
    """Classes, transitions and emissions from all blocks' texts that are learned from.

    Transitions are counted over all pairs of neighbours of which one at least is frequent. Words that were learned once tell how likely
    words are that were never learned, after each class, and what follows them.
    """
    spark = blocks.sparkSession
    vocab = vocabulary(blocks)
    frequent, tokens, words = frequent_words(vocab, frequent_limit)
    seeds = min(seeds, len(frequent.n))
    classes = min(classes, seeds)
    bigrams = seed_bigrams(blocks, frequent, seeds)
    of = exchange(bigrams, classes)
    if seeds < len(frequent.n):
        member = np.eye(classes, dtype=np.int64)[of]
        sides = affinities(member.T @ bigrams @ member)
        found = classify(frequent_neighbours(blocks, frequent, of, seeds, classes), *sides).select("id", "class").toPandas()
        more = np.zeros(len(frequent.n), np.int64)
        more[:seeds] = of
        more[found["id"].to_numpy()] = found["class"].to_numpy()
        of = more
    table = frequent_transitions(blocks, frequent, of, classes)
    size = np.bincount(of, weights=frequent.n, minlength=classes)
    table = np.vstack([table, np.zeros(classes)])
    after = table.sum(axis=1)  # tokens after each class
    once = np.zeros(classes + 1)
    if words > len(frequent.n):
        rare = common.materialize(classify(rare_neighbours(blocks, frequent, of, classes), *affinities(table[:classes])), "lm-rare")
        for k, lr, single, n in _rare_transitions(rare):
            left, right = divmod(lr, classes + 1)
            size[k] += n
            after[left] += n
            if left < classes:
                table[left, k] += n
            if right < classes:
                table[k, right] += n
            if single:
                once[left] += n
                if right < classes:
                    table[classes, right] += n
    else:
        rare = spark.createDataFrame([], "id long, n long, class int")
    share = np.maximum(size, 1e-9) / max(size.sum(), 1e-9)
    step = (table + SMOOTHING * share) / (table.sum(axis=1) + SMOOTHING)[:, None]
    step /= step.sum(axis=1, keepdims=True)
    new = (once + 0.5) / (after + 1)
    new[classes] = (once.sum() + 0.5) / (after.sum() + 1)
    return Model(frequent, of, rare, tokens, words, np.maximum(size, 1e-9), step, new)


def _rare_transitions(rare: DataFrame) -> list[tuple]:
    """(class, neighbours' classes, whether the word was learned once, tokens), added up over all words that aren't frequent: 2 * classes * (classes + 1)^2 rows at most."""
    rows = rare.select("class", (F.col("n") == 1).alias("single"), F.inline("seen")).groupBy("class", "lr", "single").agg(F.sum("n").alias("n"))
    return [(r["class"], r["lr"], r["single"], r["n"]) for r in rows.collect()]


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every document.

    A block's words that aren't frequent are looked up by their hash, and what is found is sent back to the block; texts aren't joined with words.
    """
    frequent, of, classes, end = model.frequent, model.of, len(model.size), int(model.of[0])
    kept = Model(frequent, of, None, model.tokens, model.words, model.size, model.step, model.new)
    base = np.log10(max(model.tokens, 0) + 0.5 * (model.words + 1))

    def rare_codes(parts):
        for part, i, b in _each(parts):
            at = np.flatnonzero(frequent.ranks(b.words) < 0)
            yield _batch(["block", "code", "id"], np.full(len(at), part.column("block")[i].as_py(), np.int64), at.astype(np.int32), b.words[at].view(np.int64))

    def ranked(parts):
        """The blocks with their words' ranks in two bytes each in place of hashes, as words are looked up by now."""
        import pyarrow as pa

        for part in parts:
            ranks = [frequent.ranks(np.frombuffer(w.as_buffer(), np.uint64)) for w in part.column("words")]
            told = pa.array([np.where(r < 0, NO_RANK, r).astype(np.uint16).tobytes() for r in ranks], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("block", "ids", "held", "lengths", "codes")), told], ["block", "ids", "held", "lengths", "codes", "ranks"])

    def rate(parts):
        import pyarrow as pa

        for part in parts:
            for i in range(part.num_rows):
                rank = np.frombuffer(part.column("ranks")[i].as_buffer(), np.uint16).astype(np.int64)
                lengths = part.column("lengths")[i].values.to_numpy()
                codes = np.frombuffer(part.column("codes")[i].as_buffer(), np.uint16 if len(rank) <= 1 << 16 else np.uint32)
                near = np.minimum(rank, len(of) - 1)
                n, own = np.where(rank < NO_RANK, frequent.n[near], 0), np.where(rank < NO_RANK, of[near], classes)
                if part.column("met")[i].is_valid:
                    met = part.column("met")[i].values.to_numpy().astype(np.int64)  # code * classes + class
                    n[met // classes], own[met // classes] = part.column("met_n")[i].values.to_numpy(), met % classes
                own = np.where(n > 0, own, classes)
                now, count = own[codes], n[codes]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), np.log10(count + 0.5) - base, kept.log10(_before(now, end), now, count))]
                ids, held = part.column("ids")[i].values, part.column("held")[i].values
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(lengths, pa.int64()), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    told = _map(blocks, rare_codes, "block long, code int, id long").join(model.rare.select("id", "n", "class"), "id")
    # both lists are gathered row by row together, so they are in one order
    met = told.groupBy("block").agg(F.collect_list((F.col("code").cast("long") * classes + F.col("class")).alias("met")).alias("met"), F.collect_list("n").alias("met_n"))
    kinds = dict(blocks.dtypes)
    rows = _map(blocks, ranked, f"block long, ids {kinds['ids']}, held array<boolean>, lengths array<int>, codes binary, ranks binary").join(met, "block", "left")
    kind = kinds["ids"].removeprefix("array<").removesuffix(">")
    scores = common.map_arrow(rows, rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    with common.rows_at_a_time(blocks.sparkSession, BLOCKS_AT_A_TIME):
        return common.materialize(scores, "lm-scores")


def lm_scores(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text.

    Null text counts as empty; an empty text is its end alone. Texts of any length are scored whole. Rows that repeat are learned from and scored each; ties
    in frequency are broken by the words' hashes, so reruns agree. A null doc_id is told as held out or not like an empty one. Where nothing is learned from, both scores are 0. An
    empty table gives no rows; other columns are ignored.
    """
    blocks = encoded(docs)
    model = fit(blocks, classes)
    found = score(blocks, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op12_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.read_table(spark, sf_dir, "documents"))
