"""Communities against a plain sequential run, and after a change of the edges."""

import random
from collections import defaultdict

import pytest

from recallspark.operators import communities


def planted(groups=8, size=12, seed=5):
    """Edges {(a, b): weight} of groups that are dense within and thin between."""
    dice, nodes = random.Random(seed), [f"n{i:03d}" for i in range(groups * size)]
    pairs = [(a, b, i // size == j // size) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i < j]
    return {(a, b): float(dice.randint(1, 3)) for a, b, inside in pairs if dice.random() < (0.5 if inside else 0.03)}


def modularity(edges, member):
    m, inner, volume = sum(edges.values()), 0.0, defaultdict(float)
    for (a, b), w in edges.items():
        inner += w * (member[a] == member[b])
        volume[member[a]] += w
        volume[member[b]] += w
    return inner / m - sum((v / (2 * m)) ** 2 for v in volume.values())


def gains(edges, member):
    """(node, community, gain) of every move of a single node to a neighbour's community, in units of weight."""
    near, k, m = defaultdict(lambda: defaultdict(float)), defaultdict(float), sum(edges.values())
    for (a, b), w in edges.items():
        k[a] += w
        k[b] += w
        if a != b:
            near[a][member[b]] += w
            near[b][member[a]] += w
    volume = defaultdict(float)
    for n, c in member.items():
        volume[c] += k[n]
    for n, c in member.items():
        stay = near[n][c] - k[n] * (volume[c] - k[n]) / (2 * m)
        for d in list(near[n]):
            if d != c:
                yield n, d, near[n][d] - k[n] * volume[d] / (2 * m) - stay


def sequential(edges):
    """Node after node moves where it gains most, then communities as nodes, until nothing gains."""
    nodes = sorted({n for e in edges for n in e})
    names, now = {n: n for n in nodes}, dict(edges)
    while True:
        member, moved = {n: n for e in now for n in e}, False
        while best := max(gains(now, member), key=lambda g: (g[2], g[0], g[1]), default=None):
            if best[2] <= 1e-9:
                break
            member[best[0]], moved = best[1], True
        if not moved:
            return names
        names = {n: member[c] for n, c in names.items()}
        up = defaultdict(float)
        for (a, b), w in now.items():
            up[tuple(sorted((member[a], member[b])))] += w
        now = dict(up)


def table(spark, edges, chat="x"):
    return spark.createDataFrame([(chat, a, b, w) for (a, b), w in edges.items()], "chat_id string, a string, b string, weight double")


def as_dict(found):
    rows = found.collect()
    assert len(rows) == len({r.key for r in rows})
    return {r.key: r.community for r in rows}


@pytest.fixture(scope="module")
def whole(spark):
    edges = planted()
    found = communities.detect(table(spark, edges), least=0)
    return edges, found, as_dict(found)


def test_as_good_as_a_sequential_run(spark, whole):
    edges, found, member = whole
    best = modularity(edges, sequential(edges))
    assert modularity(edges, member) >= 0.98 * best > 0.3
    assert communities.modularity(table(spark, edges), found).first().modularity == pytest.approx(modularity(edges, member), abs=1e-12)
    assert all(c == min(n for n, d in member.items() if d == c) for c in member.values())


def test_a_level_settles(spark):
    """With ``least`` 0 no node gains by a move; loops count twice in a node's weight."""
    edges = planted(4, 8, 2) | {("n000", "n000"): 4.0}
    member = as_dict(communities._move(communities._weighted(table(spark, edges)), 1.0, 100, 0.0))
    assert max(g for _, _, g in gains(edges, member)) <= 1e-6


def test_crowds_are_dealt_over_rounds(spark, monkeypatch):
    """Where one community is wished for by more than HOT nodes they enter in parts; chats are kept apart."""
    monkeypatch.setattr(communities, "HOT", 3)
    star = {("hub", f"leaf{i:02d}"): 1.0 for i in range(20)}
    both = table(spark, star).unionByName(table(spark, star | {("p", "q"): 5.0}, "y"))
    rows = communities.detect(both, least=0).collect()
    assert {(r.chat_id, r.key in "pq", r.community) for r in rows} == {("x", False, "hub"), ("y", False, "hub"), ("y", True, "p")} and len(rows) == 44


def test_after_a_change(spark, whole):
    """With a hundredth of new edges, one that is gone and a new node, as good as a whole run within 1 %, and fewer nodes are looked at."""
    edges, found, member = whole
    dice, nodes = random.Random(1), sorted(member)
    new = {}
    while len(new) < len(edges) // 100:
        pair = tuple(sorted(dice.sample(nodes, 2)))
        if pair not in edges:
            new[pair] = 2.0
    gone = next(iter(edges))
    now = {e: w for e, w in edges.items() if e != gone} | new | {("n000", "zz"): 3.0}
    changed = spark.createDataFrame([("x", *e) for e in [*new, gone, ("n000", "zz")]], "chat_id string, a string, b string")
    trace = []
    after = as_dict(communities.refresh(table(spark, now), found, changed, trace=trace))
    assert set(after) == {n for e in now for n in e} and after["zz"] == after["n000"]
    assert modularity(now, after) >= 0.99 * modularity(now, sequential(now))
    assert trace[0] <= 2 * (len(new) + 2) and sum(trace) < len(after)


def test_nothing(spark):
    none = table(spark, {("a", "b"): 1.0}).limit(0)
    assert communities.detect(none).count() == 0
