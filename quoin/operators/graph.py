"""Graph operators over edges (src, dst): degrees, components, reach, levels and numbers of dependents.

Graphs are solved in rounds of joins and aggregates spread by node; contraction (contracting.py) keeps the number of
rounds from growing with the length of ways. Every round is kept in storage, so that no plan grows with their number,
and removed at the end. A remainder of up to LOCAL_EDGES edges goes to one task; few = 0 leaves none. Both ways give the
same rows. No adjacency list is ever gathered, so nodes with very many neighbours are nothing special.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators.contracting import above, carried, contracted, longest, on_cycles, weighted
from quoin.operators.ranking import numbered
from quoin.operators.solving import Graph, in_one_task
from quoin.plans.storage import passing, settled

#: Edges of a remainder that one task solves.
LOCAL_EDGES = 1 << 14
#: Words of 64 bits in a row of dependents.
WORDS = 4


def _held(edges: DataFrame) -> DataFrame:
    """The distinct edges between different nodes, kept."""
    return settled(edges.select("src", "dst").filter("src <> dst").distinct())


def _few_of(few: int | None) -> int:
    return LOCAL_EDGES if few is None else few


def _type(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def edges_between(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, ord) from imports (path, ord, resolved) to other known files; the first import counts."""
    known = imports.filter("resolved is not null and resolved <> path").join(files.select(F.col("path").alias("resolved")), "resolved", "left_semi")
    return known.groupBy(F.col("path").alias("src"), F.col("resolved").alias("dst")).agg(F.min("ord").alias("ord"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of the nodes that touch an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def _with(known: DataFrame, fresh: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """known and fresh; every sixteenth round they are put together in storage, so that plans stay short."""
    both = known.unionAll(fresh)
    return settled(both) if rounds % 16 == 15 else both, rounds + 1


def _component_rows(graph: Graph, _: pd.DataFrame) -> pd.DataFrame:
    component = graph.components()
    on_cycles = np.bincount(component, minlength=graph.n)[component] > 1
    own = on_cycles & (component != np.arange(graph.n))
    return pd.DataFrame({"node": graph.names[own], "label": graph.names[component[own]]})


def components(edges: DataFrame, held: bool = False, few: int | None = None) -> DataFrame:
    """(node, component) for the nodes on cycles, named after their smallest node; held: the edges are distinct and kept already."""
    with passing(edges.sparkSession) as kept:
        left = edges.select("src", "dst") if held else _held(edges)
        labels = settled(_labels(left, _few_of(few)))
        own = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        names = own.groupBy("label").agg(F.min("node").alias("component"))
        told = settled(own.join(names, "label").select("node", "component"))
        kept.append(told)
    return told


def _labels(edges: DataFrame, few: int, depth: int = 0) -> DataFrame:
    """(node, label) of the nodes on cycles, but for the one of each component whose name all others have.

    The graph is contracted; in what is left, each node learns the least of the nodes that lead to it and of those that it
    leads to, by a hash, so that any may be least. Where both are the same node, its component is known; the others lie
    between nodes that agree in both, and are looked for there.
    """
    core, rounds = contracted(weighted(edges, 0), few, ending=False)
    core = core.select("src", "dst")
    if core.isEmpty():
        labels = edges.sparkSession.createDataFrame([], f"node {_type(edges)}, label {_type(edges)}")
    elif core.count() <= few:
        labels = settled(in_one_task(core, _component_rows, f"node {_type(edges)}, label {_type(edges)}"))
    else:
        told = _least(core, depth).join(_least(core.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth).toDF("node", "after"), "node")
        told = settled(told.select("node", F.col("least").alias("a"), F.col("after").alias("b")))
        same = core.join(told.toDF("src", "a", "b"), "src").join(told.toDF("dst", "c", "d"), "dst").filter("a = c and b = d and a <> b")
        left = settled(same.select("src", "dst"))
        labels = told.filter("a = b and node <> a").select("node", F.col("a").alias("label"))
        if not left.isEmpty():
            labels = labels.unionByName(_labels(left, few, depth + 1))
    return carried(labels, rounds, on_cycles)


def _least(edges: DataFrame, seed: int) -> DataFrame:
    """(node, least): of a node and all that lead to it the one of the least hash.

    Each round also looks at what the least one known knows, so ways are halved where they are long.
    """
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    now = settled(nodes.select("node", F.struct(F.xxhash64("node", F.lit(str(seed))).alias("h"), "node").alias("least"), F.lit(True).alias("new")))
    while True:
        told = now.filter("new").join(edges.select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("dst").alias("node")).agg(F.min("least").alias("told"))
        step = now.join(told, "node", "left").select("node", F.col("least").alias("was"), F.least("least", "told").alias("least"))
        further = now.select(F.col("node").alias("at"), F.col("least").alias("further"))
        jump = step.join(further, F.col("least.node") == F.col("at"), "left").select("node", "was", F.least("least", "further").alias("least"))
        now = settled(jump.select("node", "least", (F.col("least") < F.col("was")).alias("new")))
        if now.filter("new").isEmpty():
            return now.select("node", F.col("least.node").alias("least"))


def _reached_rows(graph: Graph, table: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"node": graph.names[graph.reached(table.code[~table.edge].to_numpy())]})


#: Rounds of a plain search before the rest of a graph is contracted.
STEPS = 12


def reachable(edges: DataFrame, seeds: DataFrame, held: bool = False, few: int | None = None) -> DataFrame:
    """(node): the seeds and what can be reached from them.

    Where each node has one edge out at most, ways are folded and doubled. Elsewhere it is a search from the frontier, which
    Spark sends to all tasks while it is small and joins by node when it isn't. If that takes long, the part not reached yet
    is contracted, so ways of any length take few rounds.
    """
    few = _few_of(few)
    with passing(edges.sparkSession) as kept:
        own = edges.select("src", "dst") if held else _held(edges)
        known = settled(seeds.select("node").distinct())
        if own.count() <= few and known.count() <= few:
            told = settled(in_one_task(own.unionAll(known.select("node", F.lit(None).cast(_type(own)))), _reached_rows, f"node {_type(own)}"))
        else:
            forest = above(own, known)
            told = settled(_searched(own, known, few) if forest is None else forest)
        kept.append(told)
    return told


def _searched(own: DataFrame, known: DataFrame, few: int, most: int | None = STEPS) -> DataFrame:
    fresh, rounds = known, 0
    while not fresh.isEmpty():
        if rounds == most:
            return known.unionByName(_far(own, known, fresh, few))
        fresh = settled(fresh.join(own.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti"))
        known, rounds = _with(known, fresh, rounds)
    return known


def _far(own: DataFrame, known: DataFrame, fresh: DataFrame, few: int) -> DataFrame:
    """(node) of what isn't known, but reached from fresh: values carried over edges turned round, 1 where a way comes from fresh."""
    rest = settled(own.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    first = rest.join(fresh.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("src"), F.lit(None).cast(_type(own)).alias("dst"), F.lit(1).cast("long").alias("weight")).distinct()
    inner = rest.join(known.withColumnRenamed("node", "src"), "src", "left_anti")
    core, rounds = contracted(first.unionByName(weighted(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 0)), few)
    begun = settled(core.filter("dst is null and weight > 0").select(F.col("src").alias("node")).distinct())
    ways = core.filter("dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if core.count() <= few:
        there = in_one_task(ways.unionAll(begun.select("node", F.lit(None).cast(_type(own)))), _reached_rows, f"node {_type(own)}")
    else:
        there = _searched(ways, begun, few, None)
    values = settled(there.select("node", F.lit(1).cast("long").alias("value")))
    return carried(values, rounds, longest).filter("value > 0").select("node")


def condensed(edges: DataFrame, nodes_of: DataFrame) -> DataFrame:
    """Edges between components, named by nodes_of (node, component); other nodes stand for themselves."""
    a, b = nodes_of.select(F.col("node").alias("src"), F.col("component").alias("ca")), nodes_of.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    named = edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst"))
    return named.filter("src <> dst").distinct()


def _level_rows(graph: Graph, table: pd.DataFrame) -> pd.DataFrame:
    ends = table[~table.edge]
    return pd.DataFrame({"node": graph.names, "value": graph.longest(ends.code.to_numpy(), ends.weight.to_numpy())})


def levels(dag: DataFrame, few: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, level): the length of the longest way from a node; a graph with cycles must be condensed before.

    The graph is contracted until nothing or little is left, and levels are carried back, so chains and trees of any depth take few rounds.
    known (node, level): of nodes that have no edges here, and aren't given back.
    """
    few = _few_of(few)
    with passing(dag.sparkSession) as kept:
        edges = _held(dag)
        ways, nodes = weighted(edges, 1), edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
        if known is not None:
            ended = ways.join(known.toDF("dst", "level"), "dst", "left").select("src", F.when(F.col("level").isNull(), F.col("dst")).alias("dst"), (F.col("weight") + F.coalesce("level", F.lit(0))).alias("weight"))
            ways, nodes = ended.groupBy("src", "dst").agg(F.max("weight").alias("weight")), nodes.join(known, "node", "left_anti")
        left, rounds = contracted(ways, few, acyclic=True)
        values = settled(in_one_task(left, _level_rows, f"node {_type(edges)}, value long"))
        told = settled(nodes.join(carried(values, rounds, longest), "node", "left").select("node", F.coalesce("value", F.lit(0)).cast("int").alias("level")))
        kept.append(told)
    return told


def violations(edges: DataFrame, nodes_of: DataFrame) -> DataFrame:
    """Edges against the levels: those inside a component, as all others lead to a lower level."""
    a, b = nodes_of.select(F.col("node").alias("src"), F.col("component").alias("ca")), nodes_of.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst")


def _radius_rows(graph: Graph, _: pd.DataFrame) -> pd.DataFrame:
    radius = graph.dependents()
    return pd.DataFrame({"node": graph.names[radius > 0], "radius": radius[radius > 0]})


def units(edges: DataFrame, nodes_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst) between components and single nodes, (node, unit, size) of all nodes)."""
    sizes = nodes_of.groupBy("component").agg(F.count("*").alias("size"))
    named = nodes_of.join(sizes, "component")
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    of = nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("unit"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    return settled(condensed(edges, nodes_of)), settled(of)


#: Lots of 64 * WORDS units that are counted in one pass: rows of bits are at most so many times the units.
PASS = 16


def counted(dag: DataFrame, heads: DataFrame, told: DataFrame) -> DataFrame:
    """(unit, n): for each unit of heads (unit), the sizes of the units that lead to it along dag (told: unit, size), summed.

    Heads are bits, 64 * WORDS to a row (node, lot, words). The bits go against the edges until nothing is new; the sizes
    of the nodes that a bit has come to are then summed for it. PASS lots go at a time, and only their sums are kept.
    """
    words = [f"w{i}" for i in range(WORDS)]
    zero = F.lit(0).cast("long")
    placed = settled(numbered(heads, ["unit"], "place").select("unit", F.floor(F.col("place") / (64 * WORDS)).alias("lot"), F.pmod("place", F.lit(64 * WORDS)).cast("int").alias("bit")))
    lots = placed.agg(F.max("lot")).head()[0]
    sums = []
    for lot in range(0, 0 if lots is None else lots + 1, PASS):
        own = placed.filter((F.col("lot") >= lot) & (F.col("lot") < lot + PASS))
        bits = [F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(zero).alias(w) for i, w in enumerate(words)]
        fresh, known = own.select(F.col("unit").alias("dst"), "lot", *bits), None
        while True:
            step = fresh.join(dag, "dst").groupBy(F.col("src").alias("node"), "lot").agg(*(F.bit_or(w).alias(w) for w in words))
            if known is None:
                merged = settled(step.select("*", *(F.col(w).alias(f"n{w}") for w in words)))
            else:
                both = step.join(known.select("node", "lot", *(F.col(w).alias(f"o{w}") for w in words)), ["node", "lot"], "full")
                was, now = [F.coalesce(f"o{w}", zero) for w in words], [F.coalesce(w, zero) for w in words]
                merged = settled(both.select("node", "lot", *(a.bitwiseOR(b).alias(w) for a, b, w in zip(was, now, words, strict=True)), *(b.bitwiseAND(F.bitwise_not(a)).alias(f"n{w}") for a, b, w in zip(was, now, words, strict=True))))
            known = merged.select("node", "lot", *words)
            new = merged.filter(" or ".join(f"n{w} <> 0" for w in words))
            if new.isEmpty():
                break
            fresh = new.select(F.col("node").alias("dst"), "lot", *(F.col(f"n{w}").alias(w) for w in words))
        # the sizes under each bit, summed bit by bit before anything moves
        sized = known.join(told.select(F.col("unit").alias("node"), "size"), "node")
        set_ = [F.sum(F.expr(f"shiftright(w{b // 64}, {b % 64}) & 1") * F.col("size")).alias(f"b{b}") for b in range(64 * WORDS)]
        by_bit = sized.groupBy("lot").agg(F.array(*set_).alias("sums")).select("lot", F.posexplode("sums").alias("bit", "n"))
        sums.append(settled(own.join(by_bit, ["lot", "bit"]).select("unit", "n").filter("n > 0")))
    return reduce(DataFrame.unionAll, sums) if sums else placed.select("unit", F.lit(0).cast("long").alias("n")).filter("false")


def radii(edges: DataFrame, held: bool = False, few: int | None = None) -> DataFrame:
    """(node, radius): how many other nodes reach a node, of those that any reaches.

    Nodes that reach each other have the same dependents, so components count as one node of their size.
    """
    few = _few_of(few)
    with passing(edges.sparkSession) as kept:
        own = edges.select("src", "dst") if held else _held(edges)
        if own.count() <= few:
            told = settled(in_one_task(own, _radius_rows, f"node {_type(own)}, radius long"))
        else:
            told = settled(_radii(own, few, None))
        kept.append(told)
    return told


def largest_radii(edges: DataFrame, eligible: DataFrame, held: bool = False, few: int | None = None) -> DataFrame:
    """(node, radius) of nodes among which are all those of eligible (node) that the most other nodes reach.

    What a node leads to (and isn't in one component with) has more dependents than the node, so only components that lead
    to no other eligible one count. Of these, sketches of what reaches them rule out all that can't be largest, and the
    rest are counted.
    """
    few = _few_of(few)
    with passing(edges.sparkSession) as kept:
        own = edges.select("src", "dst") if held else _held(edges)
        if own.count() <= few:
            told = settled(in_one_task(own, _radius_rows, f"node {_type(own)}, radius long"))
        else:
            told = settled(_radii(own, few, eligible))
        kept.append(told)
    return told


def _radii(own: DataFrame, few: int, eligible: DataFrame | None) -> DataFrame:
    dag, of = units(own, components(own, held=True, few=few))
    told = of.select("unit", "size").distinct()
    heads = told.select("unit")
    if eligible is not None:
        may = of.join(eligible, "node", "left_semi").select("unit").distinct()
        back = dag.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        above = back.join(may.withColumnRenamed("unit", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        last = settled(may.join(reachable(back, above, held=True, few=few).withColumnRenamed("node", "unit"), "unit", "left_anti"))
        heads = _largest(dag, of, last)
        of = of.join(heads, "unit", "left_semi")
    sums = counted(dag, heads, told)
    return of.join(sums, "unit", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("radius")).filter("radius > 0")


#: Sketches of 2^SKETCH registers, whose standard error is about 0.84 / 2^(SKETCH / 2); so many errors rule a node out.
SKETCH, ERRORS = 12, 6


def _largest(dag: DataFrame, of: DataFrame, heads: DataFrame) -> DataFrame:
    """(unit) of heads but for those whose dependents, by sketches carried down dag, can't be the most."""
    if heads.count() <= 64 * WORDS * PASS:  # one pass counts them all
        return heads
    sketch = settled(of.groupBy("unit").agg(F.hll_sketch_agg("node", F.lit(SKETCH)).alias("sketch")))
    now = sketch.withColumn("known", F.hll_sketch_estimate("sketch")).withColumn("new", F.lit(True))
    while True:
        step = dag.join(now.filter("new").select(F.col("unit").alias("src"), "sketch"), "src").select(F.col("dst").alias("unit"), "sketch")
        both = now.select("unit", "sketch").unionAll(step).groupBy("unit").agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("estimate", F.hll_sketch_estimate("sketch"))
        now = settled(both.join(now.select("unit", "known"), "unit").select("unit", "sketch", F.col("estimate").alias("known"), (F.col("estimate") > F.col("known")).alias("new")))
        if now.filter("new").isEmpty():
            break
    error = ERRORS * 0.84 / 2 ** (SKETCH / 2)
    own = now.join(heads, "unit", "left_semi").select("unit", "known")
    least = own.agg((F.max("known") * (1 - error) / (1 + error)).alias("least"))
    return settled(own.crossJoin(F.broadcast(least)).filter("known >= least").select("unit"))
