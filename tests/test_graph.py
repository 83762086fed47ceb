"""Graph operators against sets and searches, on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import aggregates as A
from quoin.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame(edges or [("", "")], "src string, dst string").filter("src <> ''")


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo, seen = list(after[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed,n,m,few", [(1, 12, 18, 1 << 20), (3, 9, 30, 1 << 20), (5, 60, 90, 1 << 20), (2, 15, 16, 3), (6, 40, 70, 0), (7, 30, 200, 0)])
def test_random_graphs(spark, monkeypatch, seed, n, m, few):
    """In one task, in rounds, and in rounds that leave a rest to one task."""
    monkeypatch.setattr(G, "LOCAL_EDGES", few)
    monkeypatch.setattr(G, "STEPS", 1)
    rng = random.Random(seed)
    edges = sorted({(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})
    df, ways = frame(spark, edges), reach(edges)
    members = {a: min(b for b in {x for x, _ in ways} | {a} if b == a or (a, b) in ways and (b, a) in ways) for a, b in ways if (b, a) in ways and a != b}
    comp = G.components(df)
    assert rows(comp) == sorted(members.items())
    assert rows(G.radii(df)) == sorted((x, k) for x in {b for _, b in ways} if (k := sum(1 for a, b in ways if b == x and a != x)))
    seeds = {edges[0][0], "zz"}
    assert {r[0] for r in rows(G.reachable(df, spark.createDataFrame([(s,) for s in seeds], "node string")))} == seeds | {b for a, b in ways if a in seeds}
    dag = {(members.get(a, a), members.get(b, b)) for a, b in edges} - {(x, x) for x in members.values()}
    level: dict = {}

    def deep(x):
        if x not in level:
            level[x] = max((1 + deep(b) for a, b in dag if a == x), default=0)
        return level[x]

    assert rows(G.levels(G.condensed(df, comp))) == sorted((x, deep(x)) for x in {y for e in dag for y in e})
    assert rows(G.violations(df, comp)) == [e for e in edges if members.get(e[0], 1) == members.get(e[1], 2)]


def test_edges_take_the_first_import_of_known_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    imports = spark.createDataFrame([("a", 1, "b"), ("a", 5, "b"), ("a", 2, "a"), ("a", 3, "x"), ("a", 4, None), ("b", 6, "c")], "path string, ord long, resolved string")
    assert rows(G.edges_between(imports, files)) == [("a", "b", 1), ("b", "c", 6)]


def test_blast_radius_leaves_the_foundation_out(spark):
    files = spark.createDataFrame([(p, i) for i, p in enumerate(["a", "b", "c", "foundation", "normal"])], "path string, ord long")
    edges = frame(spark, [("a", "foundation"), ("b", "foundation"), ("c", "foundation"), ("a", "normal")])
    basis = spark.createDataFrame([("foundation",)], "node string")
    r = A.blast_radius(files, G.radii(edges), basis).head()
    assert (r.radius, r.path, r.total, r.raw_value) == (1, "normal", 5, 0.2)


def test_module_aggregates(spark):
    files = spark.createDataFrame([("src/a/x.ts", 0), ("src/a/y.ts", 1), ("src/a/z.ts", 2)], "path string, ord long")
    edges = frame(spark, [("src/a/x.ts", "src/a/y.ts")])
    assert A.cohesion(files, edges).head().raw_value == 0.5
    even = frame(spark, [("src/a/x.ts", "src/b/x.ts"), ("src/a/x.ts", "src/c/x.ts")])
    assert A.entropy(even).head().raw_value == 1.0 and A.entropy(frame(spark, [])).head().raw_value == 0.0
    assert A.coupling(even, G.degrees(even)).head().raw_value == 1.0 and A.coupling(edges, G.degrees(edges)).head().raw_value == 0.0
    classes = spark.createDataFrame([("src/a/x.ts", "class")], "path string, kind string")
    assert A.distance_from_main_sequence(files, classes, G.degrees(edges)).head().raw_value == 0.5
    assert A.distance_from_main_sequence(files, classes.filter("false"), G.degrees(edges)).head().raw_value == 0.0


def test_history(spark):
    rows_ = [(f"h{i}", p, "x", 1, 1) for i in range(5) for p in "ab"] + [("h9", "c", "y", 3, 0)]
    ch = spark.createDataFrame(rows_, "hash string, path string, author string, added long, deleted long").withColumn("ts", F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    assert abs(A.change_coupling(ch).head().raw_value - 2 / 3) < 1e-12
    assert rows(A.change_pairs(ch)) == [("a", "b", 5)]
    assert A.bus_factor(ch).head().raw_value == 1.0
    assert A.churn_concentration(ch).head().raw_value == 10 / 23
    ten = spark.createDataFrame([("h", str(i), "x", 1, 0) for i in range(10)], "hash string, path string, author string, added long, deleted long")
    assert A.churn_concentration(ten).head().raw_value == 0.1
    assert A.code_age(ch, F.to_timestamp(F.lit("2026-01-01 00:00:00"))).head().raw_value == 1.0


def test_large_commits_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "CHANGED_TOGETHER", 3)
    own = [("big", f"f{i:02}") for i in range(17)] + [("small", "f01"), ("small", "f02"), ("one", "f03")]
    ch = spark.createDataFrame(own, "hash string, path string")
    want = {(f"f{i:02}", f"f{j:02}"): 1 + ((i, j) == (1, 2)) for i in range(17) for j in range(i + 1, 17)}
    assert {(r.a, r.b): r.n for r in A.change_pairs(ch).collect()} == want


def test_churn_of_many_values(spark):
    rng = random.Random(9)
    churn = [rng.choice([0, 1, 2, 3, rng.randrange(10_000)]) for _ in range(500)]
    ch = spark.createDataFrame([("h", str(i), "x", c, 0) for i, c in enumerate(churn)], "hash string, path string, author string, added long, deleted long")
    assert A.churn_concentration(ch).head().raw_value == sum(sorted(churn)[-50:]) / sum(churn)


def test_bits_of_many_nodes(spark):
    """More nodes than a lot, and than a row of words."""
    names = [f"n{i:04}" for i in range(600)]
    edges = frame(spark, list(zip(names, names[1:], strict=False)) + [("n0599", "n0590")])
    want = sorted((x, i if i < 590 else 599) for i, x in enumerate(names) if i)
    assert rows(G.radii(edges)) == want


@pytest.mark.parametrize("turned", [False, True])
def test_forests_are_folded_by_one_join_a_round(spark, monkeypatch, turned):
    from quoin.operators import contracting

    rng, kept = random.Random(4), []
    monkeypatch.setattr(contracting, "settled", lambda df, own=contracting.settled: kept.append(1) or own(df))
    edges = [(f"n{i:03}", f"n{max(0, i - rng.choice([1, 1, 1, 2, 9])):03}") for i in range(1, 60)]
    edges = [(b, a) for a, b in edges] if turned else edges
    left, rounds = contracting.contracted(contracting.weighted(frame(spark, edges), 1), 0, acyclic=True)
    assert left.isEmpty() and len(kept) <= (2 if turned else 1) * len(rounds) + 4
    after, level = {}, {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    deep = lambda x: level.setdefault(x, max((1 + deep(b) for b in after.get(x, ())), default=0))
    assert rows(G.levels(frame(spark, edges), few=0)) == sorted((x, deep(x)) for x in {y for e in edges for y in e})


@pytest.mark.parametrize("turned", [False, True])
def test_reach_over_forests_with_a_circle(spark, monkeypatch, turned):
    monkeypatch.setattr(G, "STEPS", 1)
    rng = random.Random(5)
    edges = [(f"n{i:02}", f"n{max(0, i - rng.choice([1, 1, 2, 5])):02}") for i in range(1, 30)] + [("n00", "n03")]
    edges = [(b, a) for a, b in edges] if turned else edges
    seeds = {"n09", "n25", "n02"}
    want = seeds | {b for a, b in reach(edges) if a in seeds}
    assert {r[0] for r in rows(G.reachable(frame(spark, edges), spark.createDataFrame([(s,) for s in seeds], "node string"), few=0))} == want


@pytest.mark.parametrize("folded", [1 << 20, 40])
def test_reach_over_a_forest_takes_few_rounds(spark, monkeypatch, folded):
    """Trees, a long chain and a circle: folded by two in one round, or doubled, and not looked for step by step."""
    from quoin.operators import contracting

    rng, kept = random.Random(6), []
    monkeypatch.setattr(contracting, "FOLDED", folded, raising=False)
    for module in (contracting, G):
        monkeypatch.setattr(module, "settled", lambda df, own=module.settled: kept.append(1) or own(df))
    after = {i: i - 1 if i < 200 else rng.randrange(i) for i in range(1, 300)} | {300: 301, 301: 302, 302: 300, 303: 300}
    seeds, want = {290, 199, 303, 999}, set()
    for x in seeds:
        while x is not None and x not in want:
            want.add(x)
            x = after.get(x)
    got = G.reachable(spark.createDataFrame(list(after.items()), "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "node long"), few=0)
    assert rows(got) == sorted((x,) for x in want)
    assert len(kept) <= 40


def test_a_circle_in_a_forest_has_no_levels(spark):
    with pytest.raises(ValueError, match="cycles"):
        G.levels(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]), few=0)


def test_pairs_of_more_files_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "IN_TASK", 10, raising=False)
    own = [(f"h{i % 40}", f"f{i % 7}") for i in range(280)]
    got = A.change_pairs(spark.createDataFrame(own, "hash string, path string"), 2)
    assert {(r.a, r.b): r.n for r in got.collect()} == {(f"f{i}", f"f{j}"): 40 for i in range(7) for j in range(i + 1, 7)}
    assert got.rdd.getNumPartitions() == 28
