"""Small graphs, and what contraction leaves of large ones, solved in one task over arrays.

The operators in graph.py use these for remainders of some ten thousand edges; rounds of joins give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes whose dependents are counted together: a bit of a row each.
LOT = 4096


class Graph:
    """Edges between numbers; names, sorted, stand for them."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, names: np.ndarray, weight: np.ndarray | None = None):
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.names, self.n = src[order], dst[order], names, len(names)
        self.weight = np.ones(len(src), np.int64) if weight is None else weight[order]
        self.begin = np.searchsorted(self.src, np.arange(self.n + 1))

    def condensed(self, component: np.ndarray) -> Graph:
        """Edges between different components, each once; nodes that stand for no component touch none."""
        a, b = component[self.src], component[self.dst]
        pair = np.unique((a * self.n + b)[a != b])
        return Graph(pair // max(1, self.n), pair % max(1, self.n), self.names)

    def components(self) -> np.ndarray:
        """By node, the least node of its strongly connected component (depth first, each node and edge once)."""
        begin, to = self.begin.tolist(), self.dst.tolist()
        index, low, out = [-1] * self.n, [0] * self.n, [-1] * self.n
        count, path = 0, []
        for start in range(self.n):
            if index[start] >= 0:
                continue
            index[start] = low[start] = count
            count += 1
            path.append(start)
            work = [(start, begin[start])]
            while work:
                x, at = work.pop()
                end = begin[x + 1]
                while at < end:
                    y = to[at]
                    at += 1
                    if index[y] < 0:
                        work += [(x, at), (y, begin[y])]
                        index[y] = low[y] = count
                        count += 1
                        path.append(y)
                        break
                    if out[y] < 0:
                        low[x] = min(low[x], index[y])
                else:
                    if low[x] == index[x]:
                        own = []
                        while not own or own[-1] != x:
                            own.append(path.pop())
                        least = min(own)
                        for y in own:
                            out[y] = least
                    if work:
                        above = work[-1][0]
                        low[above] = min(low[above], low[x])
        return np.array(out, np.int64)

    def longest(self, ends: np.ndarray = (), least: np.ndarray = ()) -> np.ndarray:
        """Weight of the heaviest way from each node, or that of ends where it is more; cycles raise an error."""
        order = np.argsort(self.dst, kind="stable")
        into, weight, begin = self.src[order], self.weight[order], np.searchsorted(self.dst[order], np.arange(self.n + 1))
        left, level = np.diff(self.begin), np.zeros(self.n, np.int64)
        np.maximum.at(level, np.asarray(ends, np.int64), np.asarray(least, np.int64))
        front, seen = np.flatnonzero(left == 0), 0
        while len(front):
            seen += len(front)
            size = begin[front + 1] - begin[front]
            at = np.repeat(begin[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            above = into[at]
            np.maximum.at(level, above, np.repeat(level[front], size) + weight[at])
            left = left - np.bincount(above, minlength=self.n)
            above = np.unique(above)
            front = above[left[above] == 0]
        if seen < self.n:
            raise ValueError("a graph with cycles has no levels")
        return level

    def reached(self, seeds: np.ndarray) -> np.ndarray:
        """Whether each node is a seed or can be reached from one."""
        seen = np.zeros(self.n, bool)
        seen[seeds] = True
        front = np.flatnonzero(seen)
        while len(front):
            size = self.begin[front + 1] - self.begin[front]
            at = np.repeat(self.begin[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            new = np.unique(self.dst[at])
            front = new[~seen[new]]
            seen[front] = True
        return seen

    def dependents(self) -> np.ndarray:
        """How many other nodes reach each node: sets of bits go down the condensed graph, level by level, LOT nodes at a time."""
        component = self.components()
        dag = self.condensed(component)
        level = dag.longest()
        order = np.lexsort((dag.dst, -level[dag.dst]))
        src, dst = dag.src[order], dag.dst[order]
        starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.zeros(0, np.int64)
        steps = np.append(starts, len(dst))
        cuts = np.flatnonzero(np.append(True, level[dst[starts[1:]]] != level[dst[starts[:-1]]])) if len(starts) else np.zeros(0, np.int64)
        out = np.full(self.n, -1, np.int64)  # itself doesn't count
        for lot in range(0, self.n, LOT):
            own = np.arange(lot, min(lot + LOT, self.n))
            bits = np.zeros((self.n, -(-len(own) // 64)), np.uint64)
            place = own - lot
            np.bitwise_or.at(bits, (component[own], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
            for a, b in pairwise([*cuts, len(starts)]):
                begin, end = steps[a], steps[b]
                heads = dst[starts[a:b]]
                bits[heads] |= np.bitwise_or.reduceat(bits[src[begin:end]], starts[a:b] - begin, axis=0)
            out += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)[component]
        return out


def in_one_task(rows: DataFrame, solve: Callable[[Graph, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """solve(graph, rows) in one task; rows (src, dst, ...) whose dst is null (edge is false then) tell of a node only. rows must be known to be few."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if not held or not sum(map(len, held)):
            return
        table = pd.concat(held, ignore_index=True)
        edge = table.edge.to_numpy(bool)
        names, code = np.unique(pd.concat([table.src, table.dst[edge]], ignore_index=True).to_numpy(), return_inverse=True)
        table["code"] = code[: len(table)]
        weight = table.weight[edge].to_numpy(np.int64) if "weight" in table else None
        yield solve(Graph(code[: len(table)][edge], code[len(table) :], names, weight), table)

    told = rows.withColumn("edge", F.col("dst").isNotNull()).withColumn("dst", F.coalesce("dst", "src"))
    return told.repartition(1).mapInPandas(run, schema)
