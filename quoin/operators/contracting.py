"""Contract graphs until little or nothing is left, in rounds that don't grow with the length of ways.

A node of which at most as many ways lead through as edges touch it (in * out <= in + out: sources, sinks, links of
chains, nodes of one edge in or out, and of two each way) can go: each edge into it and each out of it become one edge
past it, their weights added, and parallel edges keep the largest. Such nodes that don't touch each other go together,
those of least hash first, so that a chain loses a third in each round and a tree more. What goes is recorded; values
found for what stays are then carried back, round by round.

Forests, whose nodes have one edge out each, or one in, need no look at neighbours: an edge tells by its own two ends
whether one of them goes past the other, so a round is one join (a fourth of the edges goes), and most of a round's
shuffles are saved. What can be reached over edges of which each node has one out is found by fewer rounds still: large
forests are folded until FOLDED edges are left, whose ways are then doubled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.plans.storage import settled


@dataclass
class Round:
    """What went in one round: the edges out of its nodes and into them at that time. A null dst ends a way."""

    out: DataFrame  # src, dst, weight
    into: DataFrame | None  # src, dst, weight; none for forests
    large: bool  # whether to keep off the driver what edges are joined with
    one: bool = False  # whether no node has a second edge out


#: Edges from which on joins shuffle both sides: a side that is sent to all tasks goes by way of the driver, in each round anew.
SENT = 1 << 16

#: Edges of a forest from which on folding is less work than doubling its ways, whose rounds are fewer.
FOLDED = 1 << 20


def _joined(a: DataFrame, b: DataFrame, on: str | list[str], how: str, large: bool) -> DataFrame:
    return a.join(b.hint("merge") if large else b, on, how)


def weighted(edges: DataFrame, weight: int) -> DataFrame:
    return edges.select("src", "dst", F.lit(weight).cast("long").alias("weight"))


def contracted(edges: DataFrame, few: int, ending: bool = True, acyclic: bool = False, most: int | None = None) -> tuple[DataFrame, list[Round]]:
    """(what is left, rounds) of edges (src, dst, weight), stopped at few edges, after most rounds, or where hardly any node can go.

    ending: nodes that go may end a way, which their neighbours keep as an edge to null of its weight. acyclic: cycles raise an error.
    """
    now, rounds = settled(edges), []
    size = now.count()
    if ending and most is None and size > few:
        now, size = _folded(now, size, few, acyclic, rounds)
    while size > few and (most is None or len(rounds) < most):
        inner, large = now.filter("dst is not null"), size > SENT
        ends = now.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.col("dst").isNotNull().cast("int").alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
        degree = ends.filter("x.node is not null").groupBy("x.node").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
        order = F.struct((F.col("i") * F.col("o") > 0).alias("through"), F.xxhash64("node", F.lit(str(len(rounds)))).alias("h"), "node")
        ready = degree.select("node", F.when(F.col("i") * F.col("o") <= F.col("i") + F.col("o"), order).alias("order")).persist()
        may = ready.filter("order is not null")
        touching = _joined(_joined(inner, may.select(F.col("node").alias("src"), F.col("order").alias("a")), "src", "inner", large), may.select(F.col("node").alias("dst"), F.col("order").alias("b")), "dst", "inner", large)
        later = touching.select(F.when(F.col("a") < F.col("b"), F.col("dst")).otherwise(F.col("src")).alias("node")).distinct().withColumn("later", F.lit(True))
        marks = settled(_joined(ready, later, "node", "left", large).select("node", (F.col("order").isNotNull() & F.col("later").isNull()).alias("goes")))
        ready.unpersist()
        told = marks.agg(F.count_if("goes").alias("gone"), F.count("*").alias("nodes")).head()
        if not acyclic and told.gone * 20 < told.nodes:
            break
        going = marks.filter("goes").select("node")
        tagged = _joined(_joined(now, going.select(F.col("node").alias("src"), F.lit(True).alias("from_")), "src", "left", large), going.select(F.col("node").alias("dst"), F.lit(True).alias("to_")), "dst", "left", large)
        tagged = settled(tagged.select("src", "dst", "weight", "from_", "to_"))
        out, into = tagged.filter("from_").select("src", "dst", "weight"), tagged.filter("to_").select("src", "dst", "weight")
        onward = out.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("weight").alias("more"))
        if ending:
            onward = onward.unionByName(going.select(F.col("node").alias("mid"), F.lit(None).cast(edges.schema["dst"].dataType).alias("far"), F.lit(0).cast("long").alias("more")))
        past = _joined(into.withColumnRenamed("dst", "mid"), onward, "mid", "inner", large).select("src", F.col("far").alias("dst"), (F.col("weight") + F.col("more")).alias("weight"))
        stays = tagged.filter("from_ is null and to_ is null").select("src", "dst", "weight")
        then = settled(stays.unionByName(past if acyclic else past.filter("dst is null or src <> dst")).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
        left = then.agg(F.count("*").alias("size"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).head()
        if left.loops:
            raise ValueError("a graph with cycles has no levels")
        rounds.append(Round(out, into, large or bool(rounds) and rounds[-1].large))
        now, size = then, left.size
    return now, rounds


def _once(edges: DataFrame, node: str) -> bool:
    return edges.groupBy(node).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _folded(now: DataFrame, size: int, few: int, acyclic: bool, rounds: list[Round]) -> tuple[DataFrame, int]:
    """(what is left, its size) of a forest, its rounds added to rounds; other graphs are left as they are.

    An edge goes if the coin of the end that is single (that no other edge leaves, or leads to) is heads, and the other's is
    tails: so no two edges that follow each other go. What the single end is joined to is joined to the other instead.
    """
    inner = now.filter("dst is not null")
    fold = _forward if _once(now, "src") else _backward if _once(inner, "dst") else None
    while fold and size > few:
        heads = lambda c, seed=f"fold {len(rounds)}": F.xxhash64(c, F.lit(seed)) % 2 == 0
        now, r = fold(now, heads)
        told = now.agg(F.count("*").alias("size"), F.count("dst").alias("inner"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).head()
        if told.loops and acyclic:
            raise ValueError("a graph with cycles has no levels")
        now, size = (now.filter("dst is null or src <> dst"), told.size - told.loops) if told.loops else (now, told.size)
        rounds.append(r)
        if fold is _backward and told.inner == told.loops:
            break
    return now, size


def _forward(now: DataFrame, heads: Callable[[str], Column]) -> tuple[DataFrame, Round]:
    """A round in which each node has one edge out at most; a null dst is tails."""
    goes = heads("src") & (F.col("dst").isNull() | ~heads("dst"))
    out = now.filter(goes).select("src", "dst", "weight")
    past = out.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("weight").alias("more"))
    led = now.filter(~goes).join(past, F.col("dst") == F.col("mid"), "left")
    then = led.select("src", F.when(F.col("mid").isNotNull(), F.col("far")).otherwise(F.col("dst")).alias("dst"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
    return settled(then), Round(out, None, True, True)


def _backward(now: DataFrame, heads: Callable[[str], Column]) -> tuple[DataFrame, Round]:
    """A round in which one edge leads to each node at most. Ways that end keep their weight, but for 0, which all have."""
    goes = heads("dst") & ~heads("src")
    inner, kind = now.filter("dst is not null"), now.schema["dst"].dataType
    ends = now.filter("dst is null and weight > 0").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    going = inner.filter(goes).select(F.col("src").alias("above"), F.col("dst").alias("mid"), F.col("weight").alias("more"))
    led = inner.filter(~goes).unionAll(ends).join(going, F.col("src") == F.col("mid"), "left").select("src", "dst", "weight", "above", "more")
    last = going.filter("more > 0").select("above", F.lit(None).cast(kind), "more", F.lit(None).cast(kind), F.lit(None).cast("long"))
    kept = settled(led.unionAll(last))
    then = kept.select(F.coalesce("above", "src").alias("src"), "dst", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
    return then, Round(kept.filter("above is not null").select("src", "dst", "weight"), None, True)


def above(edges: DataFrame, known: DataFrame) -> DataFrame | None:
    """(node): known (node) and what it leads to, if each node has one edge (src, dst) out at most; None if not.

    A node that is known is told by a row without src that leads to it, and moves with the node's other edges in.
    """
    if not _once(edges, "src"):
        return None
    now = edges.select("src", "dst").unionAll(known.select(F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.col("node").alias("dst")))
    moved: list[DataFrame] = []
    while now.filter("src is not null").count() > FOLDED:
        heads = lambda c, seed=f"above {len(moved)}": F.xxhash64(c, F.lit(seed)) % 2 == 0
        goes = F.col("src").isNotNull() & heads("src") & ~heads("dst")
        past = now.filter(goes).select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        led = settled(now.filter(~goes).join(past, F.col("dst") == F.col("mid"), "left").select("src", "dst", "far"))
        moved.append(led.filter("far is not null").select("src", "dst"))
        now = led.select("src", F.coalesce("far", "dst").alias("dst")).filter("src is null or src <> dst")
    begun = settled(now.filter("src is null").select(F.col("dst").alias("node")).distinct())
    values = _doubled(settled(now.filter("src is not null")), begun)

    def back(values: DataFrame, r: DataFrame) -> DataFrame:
        led = r.filter("src is not null").join(values.withColumnRenamed("node", "src"), "src", "left_semi")
        return led.unionAll(r.filter("src is null")).select(F.col("dst").alias("node"))

    return carried(values, moved, back).distinct()


def _doubled(ways: DataFrame, known: DataFrame) -> DataFrame:
    """(node): known and what it leads to over ways (src, dst), one out of each node at most, which get twice as long in each round.

    Known is all that is less far than ways are long; where these lead to nothing new, nothing is left, in circles as well.
    """
    parts = [known]
    while True:
        told = reduce(DataFrame.unionAll, parts)
        fresh = settled(ways.join(told.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(told, "node", "left_anti"))
        if fresh.isEmpty():
            return told
        parts.append(fresh)
        if len(parts) == 9:  # so that plans stay short
            parts = [settled(reduce(DataFrame.unionAll, parts))]
        ways = settled(ways.join(ways.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")))


def carried(values: DataFrame, rounds: list[Any], back: Callable[[DataFrame, Any], DataFrame]) -> DataFrame:
    """values of what was left, with those that back(values so far, round) gives, from the last round to the first."""
    parts = [values]
    for r in reversed(rounds):
        parts.append(settled(back(reduce(DataFrame.unionByName, parts), r)))
        if len(parts) == 9:  # so that plans stay short
            parts = [settled(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def longest(values: DataFrame, r: Round) -> DataFrame:
    """(node, value) of what went: the largest of the weight of an edge out and the value of where it leads, 0 where none does. Nodes without an edge out have 0, and aren't named."""
    led = _joined(r.out, values.withColumnRenamed("node", "dst"), "dst", "left", r.large).select(F.col("src").alias("node"), (F.col("weight") + F.coalesce("value", F.lit(0))).cast("long").alias("value"))
    return led if r.one else led.groupBy("node").agg(F.max("value").alias("value"))


def on_cycles(labels: DataFrame, r: Round) -> DataFrame:
    """(node, label) of what went and is on a cycle: with that which leads to it and is led to by it. A node without a label has its own name."""

    def known(edges: DataFrame, own: str, other: str) -> DataFrame:
        told = edges.select(F.col(own).alias("node"), F.col(other).alias("at")).join(labels.toDF("at", "label"), "at", "left")
        return told.select("node", F.coalesce("label", "at").alias("label")).distinct()

    return known(r.into, "dst", "src").join(known(r.out, "src", "dst"), ["node", "label"])
