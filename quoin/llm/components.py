"""Connected components of a graph of long ids, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import dropped, map_batches, stored


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its part) for all nodes of the pairs but the smallest ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _thinned(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars: as many parts, fewer edges, shorter ways."""

    def run(batches):
        pairs: list[tuple[int, int]] = []
        for cols in batches:
            pairs.extend(zip(cols["a"], cols["b"], strict=True))
            if len(pairs) > 200_000:
                pairs = forest(pairs)
                if len(pairs) > 100_000:  # what is left won't shrink: hand it on
                    yield {"a": [x for x, _ in pairs], "b": [x for _, x in pairs]}
                    pairs = []
        pairs = forest(pairs)
        yield {"a": [x for x, _ in pairs], "b": [x for _, x in pairs]}

    return map_batches(edges, run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them: those above it (large), or those below and itself."""
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    if large:
        own = own.unionAll(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = own.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = own.join(least, "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the smallest of its component; root is the smallest.

    Alternating stars: each round shortens every way to the root, until nothing changes.
    """
    spark = edges.sparkSession
    now = stored(_thinned(edges.select("a", "b")).distinct(), "edges")
    while True:
        then = stored(_star(_star(now, True), False), "edges")
        # settled: every node hangs on one that hangs on nothing
        chained = then.select(F.col("b").alias("x")).distinct().join(then.select(F.col("a").alias("x")), "x", "left_semi")
        twice = then.groupBy("a").count().filter("count > 1")
        dropped(spark, now)
        now = then
        if chained.isEmpty() and twice.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
