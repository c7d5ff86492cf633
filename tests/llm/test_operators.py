"""The training-data operators on awkward rows, against brute-force versions."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recallspark.llm import common, components, exact_dedup, fingerprint, language, licenses, mixing, near_dedup, packing, pii, textvec, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id string, digest int, label double, row int"
ENGLISH = "the quick brown fox jumps over the lazy dog and then walks back home to sleep in the sun all day long "
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und geht dann nach Hause um den ganzen Tag zu schlafen "


def rows(*texts, lang="en", source="a", first=0):
    return [(first + i, t, lang, source, None if t is None else len(t), True, "x", i, 0.5, i) for i, t in enumerate(texts)]


LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(30_000))
AWKWARD = rows(
    "one two three four five six seven",
    "one  two\tthree four five six\nseven",
    "One two three four five six seven",
    "",
    None,
    " \t\n",
    "short",
    "short",
    "SHORT",
    "a b",
    LONG,
    LONG + " end",
    "naïve café 東京 <|endoftext|>  x",
    "!!! ??? ...",
) + rows("one two three four five six seven", None, source=None, lang=None, first=100)
AWKWARD += [AWKWARD[0], AWKWARD[4]]  # repeated rows


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup(awkward, empty):
    groups = defaultdict(list)
    for r in AWKWARD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    expected = Counter()
    for text, ids in groups.items():
        for i in ids:
            expected[i, min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_duplicates(awkward).collect())) == expected
    assert exact_dedup.exact_duplicates(empty).count() == 0
    stays = exact_dedup.drop_exact_duplicates(awkward)
    assert stays.columns == awkward.columns
    assert {r.doc_id for r in stays.collect()} == {min(ids) for ids in groups.values()}


def test_exact_dedup_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (3, "b"), (2, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()), key=str)
    assert sorted(got, key=str) == sorted(
        [(False, None, None, 2, True), (False, None, None, 2, True), (False, None, 2, 3, False), (True, 3, 2, 3, False), (True, 2, 2, 3, True)], key=str
    )


def test_drops_decide_by_row(spark):
    """Null and repeated doc_ids: a text is lost only to an equal one that stays, and of equal rows one stays."""
    data = [(None, "a"), (None, "b"), (2, "b"), (5, "x"), (3, "x"), (5, "y"), (7, "same"), (7, "same"), (None, "n"), (None, "n"), (9, None), (9, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    texts = {"a", "b", "x", "y", "same", "n", ""}
    stays = exact_dedup.drop_exact_duplicates(docs)
    assert stays.columns == docs.columns
    assert sorted((r.text or "").strip() for r in stays.collect()) == sorted(texts)
    assert {(r.doc_id, r.text) for r in stays.collect()} >= {(None, "a"), (2, "b"), (3, "x"), (5, "y"), (7, "same"), (None, "n")}
    near = near_dedup.drop_near_duplicates(docs)
    assert near.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in near.collect() if r.text), key=str)
    assert got == sorted([(None, "a"), (2, "b"), (3, "x"), (5, "y"), (7, "same"), (None, "n")], key=str)


def test_digest_index_takes_later_batches(spark):
    """Two batches, a compaction, a third batch that probes the level, and a second compaction that reads the first one's level."""
    index = exact_dedup.DigestIndex(spark, common.new_path(spark, "t"))
    batches = [[(first, "same"), (first + 1, f"own {first}")] for first in (10, 0, 20)]
    docs = [spark.createDataFrame(b, "doc_id long, text string") for b in batches]
    assert index.lookup(docs[0]).count() == 0
    index.flush(docs[0]), index.flush(docs[1])
    assert index.lookup(docs[2]).count() == 0 and len(index.runs) == 2
    assert sorted((r.keep_id, r.n) for r in index.compact().collect()) == [(0, 2), (1, 1), (11, 1)]
    assert [(r.doc_id, r.keep_id, r.n) for r in index.lookup(docs[2]).collect()] == [(20, 0, 2)]
    probed = index.filter.mark(docs[2].select("doc_id", exact_dedup.digest(F.col("text")).alias("digest")), F.col("digest")).collect()
    assert {r.doc_id: r["__maybe"] for r in probed} == {20: True, 21: False}
    index.flush(docs[2])
    assert sorted((r.keep_id, r.n) for r in index.compact().collect()) == [(0, 3), (1, 1), (11, 1), (21, 1)]
    assert index.compact().count() == 4 and not index.runs
    for level in (index.level,):
        files = level.select("digest", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
        by_file = defaultdict(list)
        for r in files:
            by_file[r.f].append(bytes(r.digest))
        assert all(d == sorted(d) for d in by_file.values())


def test_filters_lose_no_key(spark, monkeypatch):
    """Few keys are broadcast, many go by a filter of bits; both keep and drop the same rows, null keys included."""
    df = spark.createDataFrame([(i if i % 10 else None, f"t{i}") for i in range(3000)], "doc_id long, text string")
    keys = spark.createDataFrame([(i,) for i in range(0, 6000, 7)] + [(None,), (7,)], "k long")
    expected = {i for i in range(3000) if i % 10 and i % 7 == 0}
    for few in (10_000, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", few)
        kept = common.keep_keys(df, keys, "doc_id", "t")
        left = common.drop_keys(df, keys, "doc_id", "t")
        assert kept.columns == left.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == expected
        assert {r.text for r in left.collect()} == {f"t{i}" for i in range(3000) if i % 10 == 0 or i not in expected}


def test_join_by_count_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    df = spark.createDataFrame([(1 if i < 300 else i, i) for i in range(500)], "k long, v long")
    keys = df.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("k % 2 = 1")
    got = sorted(map(tuple, common.join_by_count(df, keys, "k", "c", 500).collect()))
    assert got == sorted((1 if i < 300 else i, i, 300 if i < 300 else 1) for i in range(500) if i < 300 or i % 2)
    assert common.join_by_count(df, keys, "k", "c", 500, "left").count() == 500


def brute_components(data, percent=85, width=5):
    sets = {}
    for i, t in data:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in word_list(t)]
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def check_components(df, data):
    expected = brute_components(data)
    got = df.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(data)


def test_near_dedup_awkward(awkward, empty):
    check_components(near_dedup.near_duplicate_components(awkward), [(r[0], r[1]) for r in AWKWARD])
    assert near_dedup.near_duplicate_components(empty).count() == 0
    stays = near_dedup.drop_near_duplicates(awkward)
    assert stays.columns == awkward.columns


@pytest.mark.parametrize("few", [500_000, 0])
def test_near_dedup_dense_group_without_a_centre(spark, monkeypatch, few):
    """Copies of copies: links run along chains that no single pivot sees; small blocks make the last steps work.

    With ``few`` at 0 nothing is small enough to be sent whole: filters, hot keys and salts do all joins.
    """
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "LARGE", 12)
    monkeypatch.setattr(common, "BROADCAST_KEYS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = [list(base)]
    for i in range(140):
        text = list(texts[int(rng.integers(max(0, i - 4), i + 1))])
        for _ in range(int(rng.integers(1, 3))):
            text[int(rng.integers(len(text)))] = f"x{rng.integers(10**6)}"
        texts.append(text)
    order = rng.permutation(len(texts))
    data = [(int(order[i]) + 1, " ".join(t)) for i, t in enumerate(texts)]
    check_components(near_dedup.near_duplicate_components(spark.createDataFrame(data, "doc_id long, text string")), data)


def test_near_dedup_threshold_is_exact(spark):
    """17 of 20 shingles in common links; 16 of 20 doesn't."""
    base = [f"w{i}" for i in range(22)]  # 18 shingles
    data = [(1, " ".join(base)), (2, " ".join(base[:21])), (3, " ".join(base[:19])), (4, " ".join(base[:18])), (5, " ".join(base[4:]))]
    check_components(near_dedup.near_duplicate_components(spark.createDataFrame(data, "doc_id long, text string")), data)


def test_pipeline_links_from_four_fifths_on(spark):
    """180 of 220 shingles in common: near copies in the pipeline, but not at op6's 0.85. 175 of 225 are in neither."""
    base = [f"w{i}" for i in range(204)]
    data = [(0, " ".join(base)), (1, " ".join("x" if i in (20, 60, 100, 140) else w for i, w in enumerate(base)))]
    data += [(2, " ".join(f"v{i}" for i in range(204))), (3, " ".join(f"v{i}" if i % 35 or not i else "y" for i in range(204)))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 2, 3}
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()} == {0, 1, 2, 3}
    assert [near_dedup.bands_for(p) for p in (80, 85, 100)] == [27, 19, 1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{x: 200 for x in range(200, 260)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_cross_no_text_and_no_cut(monkeypatch):
    monkeypatch.setattr(textvec, "STEP", 7)
    texts = [r[1] for r in AWKWARD[:10]] + ["x y", " z"]
    cut = [x.tolist() for x in textvec.shingle_sets(pa.array(texts), 5)]
    monkeypatch.setattr(textvec, "STEP", 1 << 20)
    assert cut == [x.tolist() for x in textvec.shingle_sets(pa.array(texts), 5)]
    assert cut[0] == cut[1] == cut[2] and len(cut[0]) == 3 and cut[3] == cut[4] == cut[5] == []


def exact_ids(text):
    return packing._exact(packing.TOKENIZER).encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows_, texts, capacity=2048):
    by_doc = defaultdict(list)
    for r in rows_:
        by_doc[r.doc_id].append(r)
    for i, found in by_doc.items():
        ids = exact_ids(texts[i])
        copies = sum(r.piece == 0 for r in found)
        for n in range(max(r.piece for r in found) + 1):
            same = [r for r in found if r.piece == n]
            assert len(same) == copies and len({(r.start, r.length) for r in same}) == 1
            part = ids[same[0].start : same[0].start + same[0].length]
            assert same[0].ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert n == 0 or same[0].length == capacity or len(ids) <= capacity
        assert sum(r.length for r in found) == copies * len(ids)
    sequences = defaultdict(list)
    for r in rows_:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(awkward, empty):
    found = packing.pack_documents(awkward).collect()
    texts = {r[0]: r[1] for r in AWKWARD}
    assert {r.doc_id for r in found} == set(texts) and sum(r.piece == 0 for r in found) == len(AWKWARD)
    used = check_packing(found, texts)
    assert used <= -(-sum(r.length for r in found) // 2048) + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(3)
    sizes = np.sort(np.minimum(2047, rng.lognormal(6.3, 0.9, 12_000).astype(int) + 1))[::-1]
    where, offset = packing.pack_pieces(sizes, 2048)
    filled = np.bincount(where, weights=sizes)
    assert filled.max() <= 2048 and (filled > 0).sum() <= 1.003 * sizes.sum() / 2048 + 1
    for w in range(0, len(filled), 97):
        if not filled[w]:
            continue
        spans = sorted((o, s) for o, s in zip(offset[where == w], sizes[where == w]))
        assert [o for o, _ in spans] == np.concatenate([[0], np.cumsum([s for _, s in spans])[:-1]]).tolist()


def test_ranks_give_the_ids_of_the_tokenizer_file():
    """The faster encoder against the tokenizer file, on random Unicode of all planes, runs of white space and look-alikes of special tokens."""
    rng = np.random.default_rng(6)
    pools = ["abcdefgh ", "ÄÖüßéñ '’", "的一是不了人東京", "0123456789.,-", " \t\n\r\x0b\u00a0\u2028", "'s't're've'm'll'd", "😀👍🏽‍\U0001F1E9", "<|endoftext>", "مرحبا שלום नमस्ते"]
    texts = ["".join(rng.choice(list(p), 200)) for p in pools for _ in range(8)]
    texts += ["".join(rng.choice(list("".join(pools)), 300)) for _ in range(60)] + ["".join(map(chr, rng.integers(1, 0xD7FF, 300))) for _ in range(20)] + [r[1] or "" for r in AWKWARD[:14]]
    for text in texts:
        assert np.frombuffer(packing.token_ids(text), "<u4").tolist() == exact_ids(text)[:-1], text[:50]


def test_null_ids(spark):
    """Null doc_ids are rows like others: packed, kept and linked with nothing, fingerprinted first."""
    data = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    packed = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == sorted((i or 0, len(exact_ids(t))) for i, t in data)
    found = fingerprint.fingerprint_with_edits(docs).collect()
    assert len(found) == 4 and len({r.fingerprint for r in found if r.doc_id != 2}) == 1
    near = near_dedup.near_duplicate_components(docs).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in near) == [(0, 2, 0, True), (0, 2, 0, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_sum_of_squares_follows_the_rule():
    """Each piece against the sum computed outright for every possible place."""
    rng = np.random.default_rng(1)
    sizes, capacity = rng.integers(1, 12, 200), 12
    where, offset = packing.sum_of_squares(sizes, capacity)
    gaps = {}
    for size, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist()):
        if size == capacity:
            continue

        def total(target):
            new = dict(gaps)
            new[target] = new.get(target, capacity) - size
            return sum(v * v for g, v in Counter(new.values()).items() if g)

        fits = [b for b, g in gaps.items() if g >= size]
        best = min([total(b) for b in fits] + [total("new")])
        assert total(w if w in gaps else "new") == best and o == capacity - gaps.get(w, capacity)
        gaps[w] = gaps.get(w, capacity) - size


def test_fingerprints(awkward, empty):
    found = sorted(fingerprint.fingerprint_with_edits(awkward).collect(), key=lambda r: r.doc_id)
    data = sorted(((r[0], r[1] or "") for r in AWKWARD))
    assert [r.doc_id for r in found] == [i for i, _ in data]
    edits = Counter((i, hashlib.sha256(fingerprint.edited(t, data[(k + 1) % len(data)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(data))
    assert Counter((r.doc_id, r.edited_sha256) for r in found) == edits
    of = dict(data)
    prints = defaultdict(set)
    for r in found:
        prints[of[r.doc_id]].add(r.fingerprint)
        assert r.n_chars == len(of[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.fingerprint_with_edits(empty).count() == 0
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_table(awkward).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in found)


def test_single_document_is_its_own_next(spark):
    one = fingerprint.fingerprint_with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


def test_samples_equal_a_plain_version():
    """One term and one sample after the other, with the draws of every term, once or more often said."""
    rng = np.random.default_rng(4)
    weights = Counter(rng.zipf(1.4, 4000).tolist())
    terms = np.array(sorted(weights), np.uint64)
    counts = np.array([weights[int(k)] for k in terms])
    _, c, r, b = fingerprint.draws(terms)
    plain = []
    for s in range(fingerprint.SAMPLES):
        best = None
        for k, w in enumerate(counts.tolist()):
            t = np.floor(np.log(w) / r[s, k] + b[s, k])
            value = np.log(c[s, k]) - r[s, k] * (t - b[s, k]) - r[s, k]
            if best is None or value < best[0]:
                best = value, int(terms[k]), int(t)
        plain.append(int(textvec.mix64(np.array([(best[1] + best[2] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0] >> np.uint64(32)))
    assert fingerprint.sample(terms, counts).tolist() == plain


def test_draws_are_gamma_and_uniform():
    x, c, r, b = (v.ravel() for v in fingerprint.draws(np.random.default_rng(2).integers(0, 1 << 64, 4000, dtype=np.uint64)))
    for v in (c, r):  # mean and variance of Gamma(2, 1) are 2
        assert abs(v.mean() - 2) < 0.02 and abs(v.var() - 2) < 0.05
    assert 0 <= b.min() and b.max() < 1 and abs(b.mean() - 0.5) < 0.005 and abs(b.var() - 1 / 12) < 0.002
    assert np.abs(np.corrcoef([c, r, b]) - np.eye(3)).max() < 0.01
    assert np.allclose(np.log(x), np.log(c) + r * b - r)


def test_unrelated_long_texts_are_unlike():
    texts = [" ".join(f"{a}{i}" for i in range(20_000)) for a in "abcd"]
    found = fingerprint.fingerprints(pa.array(texts + [texts[0] + " end"]))
    assert all(fingerprint.likeness(found[i : i + 1], found[j : j + 1])[0] < 0.05 for i in range(4) for j in range(i))
    assert fingerprint.likeness(found[:1], found[4:])[0] > 0.9


def test_samples_estimate_generalised_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        first = int(rng.integers(0, 1 << 62))
        common_, x, y = (rng.integers(0, 5000, n) for n in (rng.integers(1, 200), rng.integers(1, 200), rng.integers(1, 200)))
        a, b = Counter(np.concatenate([common_, x]).tolist()), Counter(np.concatenate([common_, y, y]).tolist())
        signatures = [fingerprint.sample(np.array(sorted(k), np.uint64) + np.uint64(first), np.array([k[j] for j in sorted(k)])) for k in (a, b)]
        errors.append((signatures[0] == signatures[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def brute_phrases(model, text, train):
    q, t = ("".join(map(chr, model.symbols(x))) for x in (text, train))
    i = n = 0
    while i < len(q):
        j = i + 1
        while j <= len(q) and q[i:j] in t:
            j += 1
        i, n = max(j - 1, i + 1), n + 1
    return n


def test_language_model_parses_longest_matches():
    train = {"en": ENGLISH * 2, "de": GERMAN * 2}
    model = language.LanguageModel(train)
    for text in (ENGLISH[5:90], GERMAN[3:70], "zebra œuvre fox Ωmega der", "x"):
        counts, _ = model.phrases([text])
        assert counts[0].tolist() == [brute_phrases(model, text, train[k]) for k in ("de", "en")]
    assert model.predict([ENGLISH, GERMAN, None, "", "123 !?", "東京"])[0] == ["en", "de", "und", "und", "und", "de"]


@pytest.mark.parametrize("stretch", [3, 7, 64, 512])
def test_language_long_texts_are_parsed_whole(monkeypatch, stretch):
    """Texts of many stretches have the phrases of the plain method, also where a phrase spans several stretches."""
    monkeypatch.setattr(language, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    train = {"en": ENGLISH * 3, "de": GERMAN * 3, "zh": "".join(map(chr, rng.integers(0x4E00, 0x5200, 800)))}
    model = language.LanguageModel(train)
    words = (ENGLISH + GERMAN).split()
    texts = [" ".join(rng.choice(words, 150)), ENGLISH * 2 + GERMAN, "".join(rng.choice(list("abcdenrst "), 900)), train["zh"][100:700] + "ab" + train["zh"][:50], "x", "the " * 300]
    counts, _ = model.phrases(texts)
    assert counts.tolist() == [[brute_phrases(model, t, train[k]) for k in ("de", "en", "zh")] for t in texts]


def test_language_portions_divide_no_text(monkeypatch):
    model = language.LanguageModel({"en": ENGLISH, "de": GERMAN})
    texts = [ENGLISH * 50, GERMAN, None, "", ENGLISH[:20]]
    whole = model.predict(texts)
    monkeypatch.setattr(language, "PORTION", 30)
    assert model.predict(texts) == whole and whole[0] == ["en", "de", "und", "und", "en"]


def test_moves_are_those_of_the_automata():
    rng = np.random.default_rng(3)
    rows_ = [{int(c): int(rng.integers(0, 300)) for c in rng.choice(40, int(rng.integers(0, 12)) if i % 3 else 1, replace=False)} for i in range(300)]
    moves = language.Moves(rows_, 40)
    state, symbol = np.repeat(np.arange(300), 40), np.tile(np.arange(40), 300)
    assert moves(state, symbol).tolist() == [rows_[q].get(c, -1) for q in range(300) for c in range(40)]
    assert len(moves.to) < 3 * sum(map(len, rows_))


def test_language_fit_is_bounded(spark):
    """A text that most rows share counts once, and leaves the executors once."""
    data = [(i, "same text for all of us", "en") for i in range(2000)] + [(i, f"text number {i} of many", "en") for i in range(2000, 2400)]
    model = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), train_chars=2000)
    assert len(model.moves.base) < 2 * 2200 and model.predict(["text number 2001 of many"])[0] == ["en"]


def test_language_table(spark, awkward, empty):
    model = language.fit(awkward)
    found = language.identify(awkward, model).collect()
    assert len(found) == len(AWKWARD)
    by = {r[0]: r[1] for r in AWKWARD}
    for r in found:
        letters = any(c.isalpha() for c in by[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.identify(awkward, language.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    stays = language.keep_identified(awkward)
    assert stays.columns == awkward.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(i for i, *_ in AWKWARD if any(c.isalpha() for c in by[i] or ""))


def test_language_never_learns_from_held_out_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, GERMAN, "de") for i in ids] + [(i, ENGLISH, "en") for i in range(60) if i not in ids], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["en"]


def brute_mix(data, cap=3, seed=17):
    order = sorted({s for _, _, s in data}, key=lambda s: (s is None, s))
    size = {s: sum(len(word_list(t)) for _, t, x in data if x == s) for s in order}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, cut = {}, set()
    while True:
        rest = sum(size.values()) - sum(cap * size[s] for s in cut)
        free = [s for s in order if s not in cut]
        target = {s: cap * size[s] if s in cut else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap * size[s]}
        if not over:
            break
        cut |= over
    return size, target


def test_mixing(awkward, empty):
    data = [(r[0], r[1], r[3]) for r in AWKWARD] + [(900, "w " * 10, "b"), (901, None, "c"), (902, "one", "d"), (903, "w " * 9000, "e")]
    docs = awkward.sparkSession.createDataFrame(data, "doc_id long, text string, source string")
    size, target = brute_mix(data)
    documents, pieces = mixing.mix(docs, block=64)
    found = documents.collect()
    assert len(found) == len(data)
    taken = Counter()
    for r in found:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    slots = defaultdict(int)
    for p in pieces.collect():
        slots[p.slot] += p.to_word - p.from_word
    assert max(slots.values()) <= 64 and sum(slots.values()) == sum(taken.values())
    again, _ = mixing.mix(docs.repartition(3), block=64)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found))
    assert mixing.mix(empty)[0].count() == 0
    assert mixing.apply_mix(awkward).columns == awkward.columns and mixing.apply_mix(empty).count() == 0
    whole = Counter(r.source for r in mixing.apply_mix(docs).collect() for _ in word_list(r.text))
    longest = {s: max(len(word_list(t)) for _, t, x in data if x == s) for s in size}
    assert all(0 <= whole[s] - int(target[s]) < max(1, longest[s]) for s in size)
    assert Counter(r.doc_id for r in mixing.apply_mix(docs).collect() if not word_list(r.text)) == Counter(i for i, t, _ in data if not word_list(t))


def test_whole_documents_follow_the_schedule(spark):
    """A document comes as often as blocks of the schedule take its first word."""
    rng = np.random.default_rng(8)
    data = [(i, "w " * int(rng.integers(1, 9)), "ab"[i % 5 == 0]) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    firsts = Counter(p.doc_id for p in mixing.mix(docs, block=16)[1].collect() if p.from_word == 0)
    assert Counter(r.doc_id for r in mixing.apply_mix(docs).collect()) == firsts


def test_whole_documents_come_in_the_order_of_the_schedule(spark):
    """The slots of the schedule give the order, so that each part of the mix has its share of every source, also where ids are missing or repeated."""
    rng = np.random.default_rng(9)
    data = [(i, "w " * int(rng.integers(1, 9)), "ab"[i >= 300]) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    slots = sorted((p.slot, p.doc_id) for p in mixing.mix(docs, block=16)[1].collect() if p.from_word == 0)
    mixed = mixing.apply_mix(docs, block=16).collect()
    slot_of = defaultdict(list)
    for s, d in slots:
        slot_of[d].append(s)
    assert Counter(r.doc_id for r in mixed) == Counter(d for _, d in slots)
    seen = Counter()
    order = []
    for r in mixed:
        order.append(slot_of[r.doc_id][seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert order == sorted(order)
    share = sum(r.source == "a" for r in mixed) / len(mixed)
    for k in (100, 200, 300, 400):
        assert abs(sum(r.source == "a" for r in mixed[:k]) / k - share) < 0.12
    unnumbered = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50))
    whole = mixing.apply_mix(unnumbered, block=16).collect()
    sized = [(r.source, r.text) for r in whole]
    targets = brute_mix([(i, t, s) for i, t, s in data])[1]
    for s in "ab":
        assert 0 <= sum(len(t.split()) for x, t in sized if x == s) - int(targets[s]) < 9


def test_schedule_spreads_sources(spark):
    sources = spark.createDataFrame([(0, 0, 300), (1, 300, 900), (2, 900, 900), (3, 900, 1000)], "source_no int, lo long, hi long")
    got = sorted(map(tuple, mixing.schedule(sources).collect()))
    assert all(0 <= s * mixing._step(1000) % 1000 - lo < hi - lo for s, no, _ in got for n2, lo, hi in sources.collect() if n2 == no)
    assert mixing.schedule(sources.limit(0)).count() == 0
    assert [s for s, *_ in got] == list(range(1000))
    for no, n in ((0, 300), (1, 600), (3, 100)):
        own = [s for s, x, _ in got if x == no]
        assert [r for s, x, r in got if x == no] == list(range(n))
        for stop in range(100, 1001, 100):  # low discrepancy: never far from its share
            assert abs(sum(s < stop for s in own) - n * stop / 1000) <= 4


def test_warc(spark):
    pages = [(3, "http://a/x y", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (7, "http://c", ""), (8, "http://d", "x" * 300_000), (1, "http://b", "<p>é</p>"), (None, "u", "x" * 300_000), (None, "v", "alone\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, digest string")
    expected = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        first = min((x for x, _, y in pages if (y or "") == (h or "") and x is not None), default=None)
        same = i == first
        expected[i, len(body), warc.base32_digest(body), "response" if same else "revisit", None if same else first] += 1
    assert Counter(map(tuple, warc.round_trip(df).collect())) == expected
    only_long = warc.round_trip(df, least_bytes=1000)
    assert only_long.filter("record_type = 'revisit'").count() == 1
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reads_a_selection_by_ranges(spark):
    folder = common.new_path(spark, "warc-test")
    df = spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 50) as html")
    index = warc.write_archives(df, folder)
    found = warc.read_records(index.filter("page_id % 7 = 0"), folder)
    assert {(r.page_id, r.url, bytes(r.payload)) for r in found.collect()} == {(i, f"http://h/{i}", (str(i) * 50).encode()) for i in range(0, 200, 7)}


def test_toxicity(spark, awkward, empty):
    rng = np.random.default_rng(2)
    plain = "this day was fine and the meeting went on for long with many people".split()
    data, labels = [], []
    for i in range(400):
        words = [plain[k] for k in rng.integers(0, len(plain), 30)]
        if bad := i % 5 == 0:
            for k in range(3):
                words[k * 7] = ["you", "idiot", "stupid", "scum", "flurb"][int(rng.integers(1, 5))]
        data.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert "flurb" in model.learned
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i].predicted == 1) == (i % 5 == 0) for i in held]) > 0.95
    odd = toxicity.score(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_toxic_labels_that_repeat_contradict_or_are_null(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + ("scum idiot flurb" if i % 2 else "fine day")) for i in range(80)] + [(None, "x"), (1, None), (3, "")], "doc_id long, text string")
    marks = [(i, 1, i % 2) for i in range(80)] + [(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (5, 0, None), (999, 1, 1)]
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 83 and all(0 <= r.score <= 1 for r in got)
    held = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in got if r.doc_id in held)


def test_toxic_words_are_learned_from_fitted_rows_only(spark):
    """A word of calibrating rows alone isn't learned, nor one of held-out rows."""
    order = {r.id: r.h % 3 for r in spark.range(3000).select("id", F.xxhash64("id").alias("h")).collect()}
    held = {i for i in order if zlib.crc32(str(i).encode()) % 4 == 2}

    def word(i):
        return "heldword" if i in held else "calword" if order[i] == 0 else "fitword"

    docs = spark.createDataFrame([(i, word(i) if i % 4 == 0 else "fine day") for i in order], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in order], "doc_id long, toxic int"))
    assert set(model.learned) == {"fitword"}


def test_toxic_capitals_of_all_alphabets():
    for text in ("ÄÖÜ ÉÀ", "ПРИВЕТ МИР", "ABC DEF"):
        one = dict(zip(toxicity.FEATURES, toxicity.Featurizer({}).one(text)))
        low = dict(zip(toxicity.FEATURES, toxicity.Featurizer({}).one(text.lower())))
        assert one["capitals"] == 1 and one["shouted"] > 0 and low["capitals"] == low["shouted"] == 0
    assert dict(zip(toxicity.FEATURES, toxicity.Featurizer({}).one("東京 A")))["capitals"] == pytest.approx(1 / 3)


def test_toxic_features_see_through_spelling():
    one = dict(zip(toxicity.FEATURES, toxicity.Featurizer({}).one("You ST00PID 1d10t!!! stuuupid")))
    assert one["lexicon_kinds"] >= 2 and one["obfuscated_hits"] > 0 and one["near_second_person"] == 1 and one["exclamations"] > 0


def test_licenses(awkward, empty):
    assert all(r.matches == [] for r in licenses.scan_licenses(awkward).collect())
    assert licenses.scan_licenses(awkward).count() == len(AWKWARD) and licenses.scan_licenses(empty).count() == 0
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        wrapped = "Foo bar baz.\n\n" + re.sub(r"\s+", " ", text) + "\n\nqux"
        assert (name, 1.0) in [(n, d) for n, d, *_ in scanner.scan(wrapped)]
        lines = "Foo.\n\n" + "\n".join(x.strip() for x in text.splitlines()) + "\n\nqux"
        assert name in [n for n, *_ in scanner.scan(lines)]
    text = "Nice work. Licensed under CC BY-NC 4.0. More text follows here"
    (found,) = scanner.scan(text)
    assert found[:2] == ("CC-BY-NC-4.0", 1.0) and text[found[2] : found[3]] == "Licensed under CC BY-NC 4.0."


def test_license_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words(t)})
    scanner = licenses.Scanner()
    for _ in range(400):
        words = licenses.words(licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))][1])
        words = [vocabulary[int(rng.integers(len(vocabulary)))] if rng.random() < 0.06 else "zzz" if rng.random() < 0.03 else w for w in words]
        words = words[: max(2, int(len(words) * rng.uniform(0.6, 1)))] + ["yyy"] * int(rng.integers(0, 3))
        best = max((licenses.dice(licenses.bigrams(words), licenses.bigrams(licenses.words(t))) for _, t in licenses.TEMPLATES))
        may = scanner._may(len(words), sum(w in scanner.vocabulary for w in words))
        got = scanner.best(words) if may else None
        assert (got is not None) == (best >= 0.8) and (got is None or abs(got[1] - best) < 1e-12)


def test_licenses_across_sentences_lines_and_paragraphs():
    """A text in its usual layout, with blank lines, and inside the prose of one paragraph."""
    scanner = licenses.Scanner()
    prose = "We walked along the river and talked about the weather for a while. " * 5
    for name, text in licenses.TEMPLATES:
        plain = re.sub(r"\s+", " ", text)
        marked = re.sub(r"(?<=[.:]) (?=\S)", "\n\n", plain)
        for within in (marked, plain):
            for before, after in (("", ""), (prose + "\n\n", "\n\n" + prose), (prose, " " + prose)):
                whole = before + within + after
                (found,) = scanner.scan(whole)
                assert found[:2] == (name, 1.0) and whole[found[2] : found[3]].split() == within.split()


def test_license_runs_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    scanner = licenses.Scanner()
    made = [(licenses.bigrams(licenses.words(t)), name) for name, t in licenses.TEMPLATES]
    for _ in range(5):
        text = []
        for _ in range(3):
            words = licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))][1].split()
            words = [w if rng.random() > 0.04 else "zzz" for w in words]
            text += [w + ("" if rng.random() > 0.2 else "\n" if rng.random() < 0.5 else ".\n\n") for w in words] + ["Prose of ours. "] * int(rng.integers(0, 3))
        pieces = [p for s, e in scanner._pieces(" ".join(text)) if (p := licenses.words(" ".join(text)[s:e]))]
        expected = set()
        for i in range(len(pieces)):
            run = []
            for j in range(i, len(pieces)):
                run += pieces[j]
                own = licenses.bigrams(run)
                expected |= {(name, round(d, 9), i, j) for b, name in made if (d := licenses.dice(own, b)) >= 0.8 - 1e-12}
                if len(run) > 400:
                    break
        assert {(r[3], round(r[1], 9), r[4], r[5]) for r in scanner._runs(pieces)} == expected


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_feistel(digits, key, tweak):
    n = len(digits)
    u = n // 2
    a, b, v = int(digits[:u]), int(digits[u:]), n - u
    for i in range(1, pii.ROUNDS + 1):
        f = int(hashlib.sha256("|".join([key, tweak, str(i), str(10**u), str(b)]).encode()).hexdigest()[:15], 16)
        a, b, u, v = b, (a + f % 10**u) % 10**u, v, u
    return f"{a:0{u}d}{b:0{v}d}"


def test_pii(spark, awkward, empty):
    texts = [
        "pay 4417744280351547 or 4417 7442 8035 1547, not 9807915762804490",
        "on 2023-02-28, 28/02/2023 and 28.02.2023 but 2023-02-30 and 1850-01-01",
        "call +1 (017) 555-7713 from 233.254.104.120, not 999.1.1.1 or version 4.0.",
        "ssn 123-45-6789 and 666-45-6789; write the.72@mail3.example.com, x@y",
        'token = "92334417744280351547ab"',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    numbers = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[0].text)
    body = brute_feistel("441774428035154", "k", "card")
    assert numbers[0][:15] == body and luhn(numbers[0]) and numbers[1].replace(" ", "") == numbers[0] and numbers[2] == "9807915762804490"
    day = re.findall(r"\d{4}-\d{2}-\d{2}", got[1].text)
    assert day[1:] == ["2023-02-30", "1850-01-01"] and day[0] != "2023-02-28"
    y, m, d = day[0].split("-")
    assert f"{d}/{m}/{y}" in got[1].text and f"{d}.{m}.{y}" in got[1].text
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} from \d+\.\d+\.\d+\.\d+, not 999\.1\.1\.1 or version 4\.0\.", got[2].text) and "555-7713" not in got[2].text
    assert "123-45-6789" not in got[3].text and "666-45-6789" in got[3].text and "the.72" not in got[3].text and "x@y" in got[3].text
    assert got[4].text == texts[4]
    assert [p.kind for p in got[3].pii] == ["ssn", "email"]
    odd = pii.pseudonymize(awkward).collect()
    assert Counter((r.doc_id, r.text) for r in odd) == Counter((r[0], r[1]) for r in AWKWARD) and pii.pseudonymize(empty).count() == 0


def test_pii_further_forms_and_their_inverse(spark):
    values = [
        ("2023-01-02T10:00:00", r"\d{4}-\d\d-\d\dT10:00:00"), ("born 1.2.2023", r"born \d{1,2}\.\d{1,2}\.\d{4}"), ("3/25/2021", r"\d/\d\d/\d{4}"), ("12/25/2021", r"\d\d/\d\d/\d{4}"),
        ("(555) 223-4567", r"\([2-9]\d\d\) [2-9]\d\d-\d{4}"), ("555.223.4567", r"[2-9]\d\d\.[2-9]\d\d\.\d{4}"), ("+44 20 7946 0958", r"\+44 \d\d \d{4} \d{4}"),
        ("GB82 WEST 1234 5698 7654 32", r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d"), ("DE89370400440532013000", r"DE\d{20}"),
        ("2001:db8:85a3:0:0:8a2e:370:7334", r"[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]:[0-9a-f]:[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}"), ("FE80::1", r"[0-9A-F]{4}::[0-9A-F]"),
        ("4417 7442 8035 1547", r"\d{4} \d{4} \d{4} \d{4}"), ("123-45-6789", r"\d{3}-\d\d-\d{4}"), ("10.20.30.40", r"\d+\.\d+\.\d+\.\d+"),
    ]
    stay = ["GB82 WEST 1234 5698 7654 33", "12:30:45", "std::vector", "555-123-4567890", "1.2.3", "31/31/2020", "00/12/2020", "1/2/1850"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([v for v, _ in values] + stay)], "doc_id long, text string")
    hidden = pii.pseudonymize(df, "k")
    got = {r.doc_id: r for r in hidden.collect()}
    for i, (value, form) in enumerate(values):
        assert re.fullmatch(form, got[i].text) and got[i].text != value and len(got[i].pii) == 1, (value, got[i].text)
    for i, value in enumerate(stay, len(values)):
        assert got[i].text == value and not got[i].pii
    for i in (7, 8):
        plain = got[i].text.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert {r.doc_id: r.text for r in pii.restore(hidden, "k").collect()} == {r.doc_id: r.text for r in df.collect()}
    assert all(r.text != values[r.doc_id][0] for r in pii.restore(hidden, "other").filter(f"doc_id < {len(values)}").collect())
    mails = spark.createDataFrame([(1, "write Ünal@example.com or me@exämple.de now")], "doc_id long, text string")
    assert re.fullmatch(r"write u[0-9a-f]{12}@example\.com or u[0-9a-f]{12}@exämple\.de now", pii.pseudonymize(mails).first().text)


def test_pii_dates_of_each_form_stay_apart(spark):
    """No two slashed dates, whichever comes first in them and with or without leading zeros, get one pseudonym, and all come back."""
    day = F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int"))
    forms = F.explode(F.array(*[F.date_format(day, f) for f in ("dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy", "M/d/yyyy")]))
    dates = spark.range(800).select(forms.alias("text")).distinct()
    hidden = pii.pseudonymize(dates, "k").cache()
    assert hidden.select("text").distinct().count() == dates.count()
    assert {r.text for r in pii.restore(hidden, "k").collect()} == {r.text for r in dates.collect()}
    hidden.unpersist()


def test_pii_permutations_are_bijections(spark):
    two = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    new = two.select("d", pii.permute_digits(F.col("d"), "k", "t").alias("p"))
    assert new.select("p").distinct().count() == 1000
    assert new.filter(pii.permute_digits(F.col("p"), "k", "t", inverse=True) != F.col("d")).count() == 0
    days = spark.range(3000).select("id", pii.permute_below(F.col("id"), 3000, "k", "t").alias("p"))
    assert tuple(days.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()) == (3000, 0, 2999)
    assert days.filter(pii.permute_below(F.col("p"), 3000, "k", "t", inverse=True) != F.col("id")).count() == 0
    some = spark.range(0, 3000, 3).select(pii.permute_below(F.col("id"), 3000, "k", "t", ok=lambda y: y % 3 == 0).alias("p"))
    assert some.filter("p % 3 = 0").distinct().count() == 1000


def test_addresses_with_leading_zeros_are_a_form_of_their_own(spark):
    texts = ["192.168.1.10", "192.168.001.010", "010.001.001.001", "192.168.01.10", "1.2.3.04", "111.222.133.244", "000.000.000.000", "0.0.0.0", "256.001.001.001"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    new = pii.pseudonymize(docs)
    told = {r.doc_id: r.text for r in new.collect()}
    assert told[3] == texts[3] and told[4] == texts[4] and told[8] == texts[8]
    assert all(told[i] != texts[i] for i in (0, 1, 2, 5, 6, 7)) and len({told[i] for i in (0, 1, 2, 5, 6, 7)}) == 6
    assert all(len(told[i]) == 15 and any(x[0] == "0" for x in told[i].split(".")) for i in (1, 2, 6))
    assert [r.text for r in pii.restore(new.drop("pii")).orderBy("doc_id").collect()] == texts
