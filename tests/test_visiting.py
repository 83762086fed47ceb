"""The deepest way in order of visits against one plain search; long chains in few rounds."""

import random

import pytest

from quoin.operators import contracting
from quoin.operators import graph as G
from quoin.operators.visiting import deepest


def plain(edges, nodes):
    """Depth and deepest way by a recursive search, neighbours in order."""
    after = {n: [] for n in nodes}
    for a, b in edges:
        after[a].append(b)
    led = {b for _, b in edges}
    seeds = [n for n in nodes if n not in led] or nodes
    depth, best = {}, {}

    def enter(n, open_):
        top = 0
        for m in after[n]:
            if m not in depth and m not in open_:
                enter(m, open_ | {m})
            if m in depth and 1 + depth[m] > top:
                top, best[n] = 1 + depth[m], m
        depth[n] = top

    for s in seeds:
        if s not in depth:
            enter(s, {s})
    way, at = [], max(seeds, key=lambda s: depth[s], default=None)
    while at is not None:
        way.append(at)
        at = best.get(at)
    return way


def asked(spark, edges, nodes, few):
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, ord long")
    n = spark.createDataFrame([(x, i) for i, x in enumerate(nodes)], "node string, ord long")
    return [r.node for r in deepest(e, n, few).orderBy("place").collect()]


def graph(seed, n, m, cyclic):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    if cyclic:  # several components, entered at several nodes, behind a seed
        pairs = [(a, b) if rng.random() < 0.4 else (min(a, b), max(a, b)) for a, b in pairs if b]
    edges = list(dict.fromkeys((names[a], names[b]) for a, b in pairs if a != b))
    rng.shuffle(names)
    return edges, names


@pytest.mark.parametrize("seed,n,m,cyclic", [(2, 16, 26, True), (5, 30, 50, True)])
def test_random_graphs_in_rounds(spark, seed, n, m, cyclic):
    edges, names = graph(seed, n, m, cyclic)
    assert asked(spark, edges, names, 0) == plain(edges, names)


def test_random_graphs_in_one_task(spark):
    for seed in range(20, 26):
        edges, names = graph(seed, 5 + seed, 40, seed % 2 == 0)
        assert asked(spark, edges, names, 1 << 14) == plain(edges, names)


@pytest.mark.parametrize("edges,path,few", [
    ("ab bc", "abc", 100), ("ab ac bd", "abd", 100), ("ab ac bd cd", "abd", 100), ("ab bc ca", "abc", 100), ("", "a", 100), ("", "a", 0),
    # a component that a seed leads to at two nodes: entered where the first call leads, not where the least name is
    ("sy sx xp py yx pq", "syxpq", 100), ("sy sx xp py yx pq", "syxpq", 0), ("sx sy xp py yx pq", "sxpy", 0),
])
def test_small_graphs(spark, edges, path, few):
    pairs = [tuple(e) for e in edges.split()]
    names = sorted({x for e in pairs for x in e} or {"a"})
    names.sort(key=lambda x: x != "s")
    assert asked(spark, pairs, names, few) == plain(pairs, names) == list(path)


def test_no_nodes(spark):
    assert asked(spark, [], [], 10) == asked(spark, [], [], 0) == []


def test_long_chains_take_few_rounds(spark):
    n = 20_000
    left, rounds = contracting.contracted(contracting.weighted(spark.range(n).selectExpr("id as src", "id + 1 as dst"), 1), 2500, acyclic=True)
    assert left.count() <= 2500 and len(rounds) < 10


def test_values_are_carried_back_along_chains(spark, monkeypatch):
    monkeypatch.setattr(G, "STEPS", 2)
    n = 1000
    chain = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    level = {r.node: r.level for r in G.levels(chain, few=500).filter("node % 97 = 0 or node = 1000").collect()}
    assert level == {k: n - k for k in range(n + 1) if k % 97 == 0 or k == n}
    ring = chain.selectExpr("src", f"dst % {n} as dst")
    assert [tuple(r) for r in G.components(ring, few=500).groupBy("component").count().collect()] == [(0, n)]
    assert G.reachable(chain, spark.range(1).selectExpr("id + 300 as node"), few=500).count() == n - 300 + 1


def test_a_dense_component_takes_no_round_for_each_step_of_its_depth(spark, monkeypatch):
    """A search of it leaves a way through all nodes, with edges past any number of them, which doesn't contract."""
    names = [f"n{i:02}" for i in range(30)]
    edges = [("in", "n00"), ("in", "out"), ("n07", "tail"), ("tail", "out"), *((a, b) for a in names for b in names if a != b)]
    written, settled = [], contracting.settled
    monkeypatch.setattr(contracting, "settled", lambda df: written.append(1) or settled(df))
    assert asked(spark, edges, ["in", "out", "tail", *names], 0) == plain(edges, ["in", "out", "tail", *names])
    assert len(written) < 60  # 2 for each of some 30 steps before, and 1 to carry each back


def test_what_is_no_node_leads_nowhere_but_is_led_to(spark):
    edges = [("a", "b"), ("b", "gone"), ("gone", "a"), ("gone", "c"), ("c", "b"), ("d", "gone")]
    for few in (0, None):
        assert asked(spark, edges, ["a", "b", "c", "d"], few) == ["d", "gone"]
