"""Merkle manifest, class-based language model and source divergence against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recallspark.llm import brown, common, divergence, merkle, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = {i: i + 32 for i in range(65, 91)}

#: Nulls in each column, empty and repeated rows, repeated ids, a language of one row, one of more than eight rows, one of more than 64.
AWKWARD = [
    (None, "Alpha beta", "en", "s", 10), (None, None, None, None, None), (3, None, "en", None, None), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (5, "", None, "t", 0),
    (6, "ÀBC déf Ω", "", "", 9), (7, "one", "xx", "s", 3), (7, "two", "xx", "s", 3),
    *[(i, f"Word{i} AND the MORE {i % 3}", "de", f"s{i % 4}", i) for i in range(20, 100)], *[(i, "Rest " * i, "fr", "s", i) for i in range(100, 112)],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def extra(df):
    from pyspark.sql import functions as F

    names = ["n", "idx", "tree", "digest", "leaf", "place", "term", "value", "block", "words", "g", "c", "lang_n"]
    return df.withColumns({c: F.lit(1) for c in names})


# ---- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(*map(field, (r[0], r[3], r[2], r[4], text)))


def up(nodes):
    return [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]


def proof_of(nodes, at):
    path = []
    while len(nodes) > 1:
        a = at // 8 * 8
        run = nodes[a : a + 8]
        path.append((run[: at - a], run[at - a + 1 :]))
        nodes, at = up(nodes), at // 8
    return path, nodes[0]


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {k: sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for k in order}
    subroots = {k: proof_of([leaf(r, r[1]) for r in leaves[k]], 0)[1] for k in order}
    found = []
    for t, k in enumerate(order):
        for i, r in enumerate(leaves[k]):
            path, sub = proof_of([leaf(x, x[1]) for x in leaves[k]], i)
            more, root = proof_of([subroots[x] for x in order], t)
            path = path + more
            own = leaf(r, r[1])
            text = r[1].translate(FOLD) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
            folded = leaf(r, text)
            for left, right in path:
                folded = H(*left, folded, *right)
            found.append((r[0], own, sub, root, H(*[x for a, b in path for x in a + b]), folded, folded == root))
    return sorted(found, key=repr)


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD[:1], AWKWARD[:2], AWKWARD[3:5] * 40, []])
def test_manifest(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    extra(frame(spark, rows)).write.parquet(folder + "/documents.parquet")
    found = [tuple(r) for r in merkle.op11_merkle_manifest(spark, folder).collect()]
    assert sorted(found, key=repr) == plain_manifest(rows)


def test_a_proof_for_some_documents_only(spark):
    docs = frame(spark, AWKWARD)
    made = merkle.manifest(docs)
    whole = {(r.doc_id, r.leaf): r.path for r in made.prove().collect()}
    asked = spark.createDataFrame([(25,), (99,), (7,)], "doc_id long")
    some = made.prove(asked).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 25, 99]
    assert all(whole[r.doc_id, r.leaf] == r.path for r in some)


def test_many_languages(spark):
    rows = [(i, "t", f"l{i % 70:02}", "s", 1) for i in range(140)]
    found = sorted(((r.doc_id, r.root) for r in merkle.manifest(frame(spark, rows)).prove().collect()))
    expected = plain_manifest(rows)
    assert len(found) == 140 and {r[3] for r in expected} == {r[1] for r in found}


# ---- divergence


def plain_divergence(rows, least=30, top=50):
    docs = [(r[2] or "", r[3] or "", [t.translate(FOLD) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    found = []
    for lang in {d[0] for d in docs}:
        df, count = Counter(), {}
        for of, source, t in docs:
            if of == lang:
                df.update(set(t))
                count.setdefault(source, Counter()).update(t)
        kept = [t for t in df if df[t] >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(sum(count.values(), Counter()))
        for s in count:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in count if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", over, top)):
                for i, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]):
                    found.append((lang, s, part, item, v, i + 1))
    return sorted(found)


@pytest.mark.parametrize("least", [30, 3, 1])
def test_divergence(spark, least):
    rows = AWKWARD + [(1000 + i, f"Zeta é{i % 5} ta\x00ta x_y {'long ' * 3000 if i == 3 else ''}", "fr", f"s{i % 3}", 5) for i in range(60)] + AWKWARD
    found = divergence.audit(extra(frame(spark, rows)), least).collect()
    assert sorted(map(tuple, found)) == plain_divergence(rows, least)


def test_divergence_in_blocks_and_tiles(spark, monkeypatch):
    """Several blocks of terms, several tiles of sources, and counts passed on early give the same."""
    for name, value in (("BLOCK_TERMS", 2), ("TILE", 2), ("HELD", 10)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(i, " ".join(chr(97 + i * j % 23) * (1 + j % 3) for j in range(12)), f"l{i % 2}", f"s{i % 7}", 1) for i in range(90)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), 3).collect())) == plain_divergence(rows, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_translate_table():
    assert divergence.terms("A[b`c{d~É\x7fZ@z\t0_".encode()) == [w.encode() for w in ("a", "b", "c", "d", "É", "z", "z")]


# ---- language model


def plain_tokens(text):
    return [w.translate(FOLD) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def check_counts(found, rows):
    learned = Counter()
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            learned.update(plain_tokens(r[1]))
    total, words = sum(learned.values()), len(learned)
    expected = []
    for r in rows:
        t = plain_tokens(r[1])
        base = sum(math.log10((learned[w] + 0.5) / (total + 0.5 * (words + 1))) for w in t)
        expected.append((r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1, len(t), sum(learned[w] > 0 for w in t), total, base))
    told = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found]
    for a, b in zip(sorted(told, key=repr), sorted(expected, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("limits", [(32, 1024, 65_535), (4, 16, 40), (2, 3, 3)])
def test_lm_counts_and_probabilities(spark, limits):
    """Counts are those of a plain version; the probabilities after any class sum to 1; a text's score is the sum over its tokens."""
    classes, seeds, frequent = limits
    rows = [tuple(r) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()] + AWKWARD[:9]
    blocks = brown.encoded(extra(frame(spark, rows)))
    model = brown.fit(blocks, classes, seeds, frequent)
    found = brown.score(blocks, model).collect()
    learned = Counter()
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            learned.update(plain_tokens(r[1]))
    assert model.tokens == sum(learned.values()) and model.words == len(learned)
    from recallspark.llm import textvec
    import pyarrow as pa

    names = [w for w in learned if w is not None]
    hashes = textvec.word_hashes(*textvec.buffers(pa.array(names)))[0] if names else []
    rare = {np.uint64(r.id & (2**64 - 1)): (r["class"], r.n) for r in model.rare.collect()}
    known = {None: (int(model.of[0]), int(model.frequent.n[0]))}
    for w, h in zip(names, hashes, strict=True):
        rank = int(model.frequent.ranks(np.array([h], np.uint64))[0])
        known[w] = (int(model.of[rank]), int(model.frequent.n[rank])) if rank >= 0 else rare[h]
        assert known[w][1] == learned[w]
    now, n = np.array([c for c, _ in known.values()]), np.array([x for _, x in known.values()])
    k = len(model.size)
    for before in range(k + 1):
        mass = 10 ** model.log10(np.full(len(now), before), now, n)
        assert mass.sum() + model.new[before] == pytest.approx(1, abs=1e-6)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in [x for x in found if x.doc_id is not None and x.doc_id > 9][:20]:
        total, last = 0.0, known[None][0]
        for w in plain_tokens(by_id[r.doc_id]):
            c, x = known.get(w, (k, 0))
            total += float(model.log10(np.array([last]), np.array([c]), np.array([x]))[0])
            last = c
        assert r.score == pytest.approx(total, rel=1e-9)


def test_lm_on_awkward_rows(spark):
    rows = AWKWARD + [(500, "word " * 30_000, "en", "s", 1), *AWKWARD]
    check_counts(brown.lm_scores(extra(frame(spark, rows))).collect(), rows)
    assert brown.lm_scores(frame(spark, [])).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    alone = brown.lm_scores(frame(spark, [(i, "a b", "en", "s", 1) for i in held])).collect()  # nothing to learn from
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(0, 0, 0.0, 0.0)] * 3


def test_lm_beats_the_base_on_held_out_texts(spark):
    found = registry.QUERIES["op12_brown_lm"](spark, "/root/testdata/sf0.01").toPandas()
    held = found[found.held_out]
    assert held.score.sum() > 0.85 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.95


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = AWKWARD
    once = sorted(map(repr, brown.lm_scores(frame(spark, rows)).collect()))
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 20)
    assert sorted(map(repr, brown.lm_scores(frame(spark, rows)).collect())) == once


def test_exchange_finds_planted_classes():
    """Words of two kinds that follow each other in turn end in classes by kind."""
    rng = np.random.default_rng(1)
    bigrams = np.zeros((40, 40), np.int64)
    for v, w in zip(rng.integers(0, 20, 20_000), rng.integers(20, 40, 20_000), strict=True):
        bigrams[v, w] += 1
        bigrams[rng.integers(20, 40), rng.integers(0, 20)] += 1
    of = brown.exchange(bigrams, 2)
    assert len(set(of[:20])) == len(set(of[20:])) == 1 and of[0] != of[39]


def test_tables_are_in_the_shared_folder(spark):
    assert common.new_path(spark, "x").startswith(common.shared_dir(spark))
