"""The deepest way in order of visits, exact for graphs with cycles, without a search by one process.

A search depth first enters a component (nodes that reach each other) once, at its root, and leaves it when all of it was
entered. So three things settle everything: the root of each component; which edges inside it lead back to a node still
open, found by searching the component from its root as a group of its own; and, these edges gone, the longest ways.
Those inside a component are found by its group too, once all that it leads to are known: what a search leaves of a dense
component is deep, doesn't contract, and would take a round of joins for each step of its depth.

The root of a component that can be entered at several nodes is where the way that the search takes ends: of all ways
over components, from a seed on, the least in the order of calls. Components give their calls round by round, each once
all that lead to it are done, and only those that lead to a component in doubt take part. A key is the list of the
numbers of the calls, of components that call more than once, on the least way.

Memory of a task: the edges of one component, and those that leave it. Rounds: as many as components, or those in doubt
and what leads to them, follow each other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators import graph as G
from quoin.operators.solving import Graph
from quoin.plans.storage import passing, settled


def walked(after: dict, root) -> tuple[list[tuple], list[tuple]]:
    """(edges back to open nodes, edges that leave), in the order of a search from root. after: of each node [(dst, whether inside)]."""
    open_, entered, back, calls = {root}, {root}, [], []
    stack = [(root, iter(after.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        for other, inside in rest:
            if not inside:
                calls.append((node, other))
            elif other in open_:
                back.append((node, other))
            elif other not in entered:
                entered.add(other)
                open_.add(other)
                stack.append((other, iter(after.get(other, ()))))
                break
        else:
            open_.discard(node)
            stack.pop()
    return back, calls


def _after(table: pd.DataFrame) -> dict:
    out: dict = {}
    for src, dst, inside in table.sort_values(["src", "ord"], kind="stable")[["src", "dst", "inside"]].itertuples(index=False):
        out.setdefault(src, []).append((dst, bool(inside)))
    return out


def _back_rows(table: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(walked(_after(table), table.root.iloc[0])[0], columns=["src", "dst"])


def _call_rows(table: pd.DataFrame) -> pd.DataFrame:
    calls = walked(_after(table), table.root.iloc[0])[1]
    return pd.DataFrame([(a, b, i) for i, (a, b) in enumerate(calls)], columns=["src", "dst", "call"])


def _level_rows(table: pd.DataFrame) -> pd.DataFrame:
    """Levels inside a component without edges back; rows that aren't edges tell how far the ways that leave a node lead."""
    edge = table.edge.to_numpy(bool)
    names, code = np.unique(pd.concat([table.src, table.dst], ignore_index=True).to_numpy(), return_inverse=True)
    src, dst = code[: len(table)], code[len(table) :]
    level = Graph(src[edge], dst[edge], names).longest(src[~edge], table.far[~edge].to_numpy(np.int64))
    return pd.DataFrame({"node": names, "level": level})


def _levels(own: DataFrame, of: DataFrame, few: int) -> DataFrame:
    """(node, level) of own, edges without those that lead back, component by component (of: node, component), those that lead to none first."""
    kind = own.schema["src"].dataType.simpleString()
    named = own.select("src", "dst").join(of.toDF("src", "a"), "src", "left").join(of.toDF("dst", "b"), "dst", "left")
    named = settled(named.select("src", "dst", "a", F.coalesce("a", "src").alias("su"), F.coalesce("b", "dst").alias("du")))
    inner = named.filter("su = du").select(F.col("a").alias("unit"), "src", "dst", F.lit(0).cast("long").alias("far"), F.lit(True).alias("edge"))
    cross = named.filter("su <> du")
    back = settled(cross.select(F.col("du").alias("src"), F.col("su").alias("dst")).distinct())
    single = settled(cross.filter("a is null").select("src", "dst"))
    waiting = settled(of.select(F.col("component").alias("unit")).distinct())
    known = settled(of.limit(0).select("node", F.lit(0).alias("level")))
    while not waiting.isEmpty():
        onward = back.join(waiting.withColumnRenamed("unit", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        above = settled(G.reachable(back, onward, held=True, few=few))
        ready = settled(waiting.join(above.withColumnRenamed("node", "unit"), "unit", "left_anti"))
        below = single.join(above.unionByName(known.select("node")).withColumnRenamed("node", "src"), "src", "left_anti")
        known = settled(known.unionByName(G.levels(below, few=few, known=known)))
        leaves = cross.join(ready.withColumnRenamed("unit", "su"), "su", "left_semi").join(known.toDF("dst", "level"), "dst", "left")
        far = leaves.groupBy(F.col("su").alias("unit"), "src").agg((F.max(F.coalesce("level", F.lit(0))) + 1).cast("long").alias("far"))
        rows = inner.join(ready, "unit", "left_semi").unionByName(far.select("unit", "src", F.col("src").alias("dst"), "far", F.lit(False).alias("edge")))
        known = settled(known.unionByName(rows.groupBy("unit").applyInPandas(_level_rows, f"node {kind}, level int")))
        waiting = settled(waiting.join(ready, "unit", "left_anti"))
    known = known.unionByName(G.levels(single.join(known.withColumnRenamed("node", "src"), "src", "left_anti"), few=few, known=known))
    nodes = own.select(F.col("src").alias("node")).unionAll(own.select("dst")).distinct()
    return nodes.join(known, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def _roots(own: DataFrame, seeds: DataFrame, of: DataFrame, few: int) -> DataFrame:
    """(component, root) for the components of of (node, component)."""
    kind = own.schema["src"].dataType.simpleString()
    named = own.join(of.toDF("src", "a"), "src", "left").join(of.toDF("dst", "b"), "dst", "left")
    cross = settled(named.select("src", "dst", "ord", F.coalesce("a", "src").alias("su"), F.coalesce("b", "dst").alias("du"), F.col("b").isNotNull().alias("into")).filter("su <> du"))
    begun = seeds.join(of, "node", "left").select(F.coalesce("component", "node").alias("unit"), "node", "ord", F.col("component").isNotNull().alias("into"))
    may = cross.filter("into").select(F.col("du").alias("component"), F.col("dst").alias("root")).unionByName(begun.filter("into").select(F.col("unit").alias("component"), F.col("node").alias("root"))).distinct()
    counts = settled(may.groupBy("component").agg(F.count("*").alias("n"), F.min("root").alias("root")))
    sure = counts.filter("n = 1").select("component", "root")
    doubt = settled(counts.filter("n > 1").select(F.col("component").alias("node")))
    if doubt.isEmpty():
        return sure
    back = settled(cross.select(F.col("du").alias("src"), F.col("su").alias("dst")).distinct())
    waiting = settled(G.reachable(back, doubt, held=True, few=few).withColumnRenamed("node", "unit"))
    ways = settled(cross.join(waiting.withColumnRenamed("unit", "du"), "du", "left_semi").select("src", "dst", "ord", "su", "du"))
    several = settled(ways.groupBy("su").agg((F.count("*") > 1).alias("several")))
    inner = own.join(of.toDF("src", "unit"), "src").join(of.toDF("dst", "other"), "dst").filter("unit = other").join(waiting, "unit", "left_semi").select("unit", "src", "dst", "ord", F.lit(True).alias("inside"))
    inner = settled(inner)
    calls = [settled(begun.join(waiting, "unit", "left_semi").select("unit", "node", F.array(F.col("ord").cast("long")).alias("key")))]
    found, done = [], 0
    while not waiting.isEmpty():
        blocked = ways.join(waiting.withColumnRenamed("unit", "su"), "su", "left_semi").select(F.col("du").alias("unit")).distinct()
        ready = settled(waiting.join(blocked, "unit", "left_anti"))
        told = reduce(DataFrame.unionByName, calls).join(ready, "unit", "left_semi").groupBy("unit").agg(F.min(F.struct("key", "node")).alias("least"))
        entered = settled(told.select("unit", F.col("least.node").alias("root"), F.col("least.key").alias("key")))
        found.append(entered.select("unit", "root"))
        out = ways.join(entered.withColumnRenamed("unit", "su"), "su")
        whole = inner.join(entered.select("unit", "root"), "unit").unionByName(out.join(inner.select(F.col("unit").alias("su")).distinct(), "su", "left_semi").select(F.col("su").alias("unit"), "src", "dst", "ord", F.lit(False).alias("inside"), "root"))
        numbers = whole.groupBy("unit").applyInPandas(_call_rows, f"src {kind}, dst {kind}, call long")
        called = out.join(numbers, ["src", "dst"], "left").join(several, "su")
        step = F.concat("key", F.when(F.col("several"), F.array(F.coalesce("call", F.col("ord").cast("long")))).otherwise(F.array().cast("array<long>")))
        calls.append(settled(called.select(F.col("du").alias("unit"), F.col("dst").alias("node"), step.alias("key"))))
        waiting = settled(waiting.join(ready, "unit", "left_anti"))
        done += 1
        if done % 16 == 0:
            calls, found = [settled(reduce(DataFrame.unionByName, calls))], [settled(reduce(DataFrame.unionByName, found))]
    known = reduce(DataFrame.unionByName, found).join(doubt.withColumnRenamed("node", "unit"), "unit", "left_semi")
    return sure.unionByName(known.select(F.col("unit").alias("component"), "root"))


def deepest(edges: DataFrame, nodes: DataFrame, few: int | None = None) -> DataFrame:
    """(place, node): the deepest way, from a seed on, of edges (src, dst, ord) between nodes (node, ord); its depth is the last place.

    Seeds are the nodes that no edge leads to, or all where there are none. Each node is entered once, neighbours in the
    order of ord, and a neighbour still open counts nothing. Of ways of one depth, the first. What isn't among nodes may be
    led to, but leads nowhere.
    """
    few = G._few_of(few)
    kind = edges.schema["src"].dataType.simpleString()
    with passing(edges.sparkSession) as kept:
        all_ = settled(edges.select("src", "dst", F.col("ord").cast("long").alias("ord")).filter("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord")))
        if all_.count() <= few and nodes.count() <= few:
            rows = all_.withColumn("edge", F.lit(True)).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("ord").cast("long").alias("ord"), F.lit(False).alias("edge")))
            told = settled(rows.repartition(1).mapInPandas(_searched, f"place long, node {kind}"))
        else:
            told = settled(_deepest(all_, nodes.select("node", F.col("ord").cast("long").alias("ord")), few))
        kept.append(told)
    return told


def _searched(parts):
    """The same by one search, for what is small."""
    held = list(parts)
    if not held:
        return
    table = pd.concat(held, ignore_index=True).sort_values("ord", kind="stable")
    own, after = table[~table.edge].src.tolist(), {}
    for src, dst in table[table.edge][["src", "dst"]].itertuples(index=False):
        after.setdefault(src, []).append((dst, True))
    led = {dst for rest in after.values() for dst, _ in rest}
    seeds = [n for n in own if n not in led] or own
    after = {n: after[n] for n in own if n in after}
    depth: dict = {}
    best: dict = {}
    for seed in seeds:
        if seed in depth:
            continue
        open_, stack = {seed}, [(seed, iter(after.get(seed, ())))]
        while stack:
            node, rest = stack[-1]
            onward = next((m for m, _ in rest if m not in depth and m not in open_), None)
            if onward is not None:
                open_.add(onward)
                stack.append((onward, iter(after.get(onward, ()))))
                continue
            depth[node] = 0
            for m, _ in after.get(node, ()):
                if m not in open_ and 1 + depth[m] > depth[node]:
                    depth[node], best[node] = 1 + depth[m], m
            open_.discard(node)
            stack.pop()
    if seeds:
        at, way = max(seeds, key=lambda s: depth[s]), []
        while at is not None:
            way.append(at)
            at = best.get(at)
        yield pd.DataFrame({"place": range(len(way)), "node": way})


def _deepest(own: DataFrame, nodes: DataFrame, few: int) -> DataFrame:
    seeds = settled(nodes.join(own.select(F.col("dst").alias("node")), "node", "left_anti"))
    own = settled(own.join(nodes.select(F.col("node").alias("src")), "src", "left_semi"))
    if seeds.isEmpty():
        seeds = settled(nodes)
    else:
        own = settled(own.join(G.reachable(own.select("src", "dst"), seeds, held=True, few=few).withColumnRenamed("node", "src"), "src", "left_semi"))
    of = G.components(own, held=True, few=few)
    if not of.isEmpty():
        roots = settled(_roots(own, seeds, of, few))
        inner = own.join(of.toDF("src", "component"), "src").join(of.toDF("dst", "other"), "dst").filter("component = other").join(roots, "component").withColumn("inside", F.lit(True))
        back = inner.groupBy("component").applyInPandas(_back_rows, f"src {own.schema['src'].dataType.simpleString()}, dst {own.schema['src'].dataType.simpleString()}")
        own = settled(own.join(settled(back), ["src", "dst"], "left_anti"))
    level = settled(_levels(own, of, few))
    top = seeds.join(level, "node", "left").select("node", "ord", F.coalesce("level", F.lit(0)).alias("level")).orderBy(F.desc("level"), "ord").limit(1)
    on = settled(top.select(F.lit(0).cast("long").alias("place"), "node", "level"))
    depth = (on.select("level").head() or [0])[0]
    down = own.join(level.toDF("src", "a"), "src").join(level.toDF("dst", "b"), "dst").filter("a = b + 1")
    jump = settled(down.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("ord", "dst")).alias("x")).select("node", F.col("x.dst").alias("to")))
    on, far = on.select("place", "node"), 1
    while far <= depth:
        on = settled(on.unionByName(on.join(jump, "node").select((F.col("place") + far).alias("place"), F.col("to").alias("node"))))
        jump = settled(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")))
        far *= 2
    return on
