"""Shards of near-equal bytes from groups that must stay whole, by Karmarkar-Karp differencing.

A partial partition is a vector of one load per shard. The two with the largest spread are taken, laid one over
the other in opposite order and added, until one is left. Partial partitions of separate blocks of groups combine
in the same way, so blocks are differenced apart on the executors, and the vectors that they leave once more.

Rows with equal text are one group (null texts too). Sizes count UTF-8 bytes plus 16 a row. Repeated rows, empty
texts and further columns need nothing special; an empty table gives no rows. A group larger than a fair share
makes its shard that much larger, as it can't be divided.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import dropped, looked_up, map_batches, partitions, stored

#: Groups differenced together in one task; vectors differenced together, on the driver at last.
BLOCK, FAN = 50_000, 4096
ROW_BYTES = 16


def differenced(loads: list[tuple[int, ...] | int], shards: int) -> tuple[list[list[int]], list[int]]:
    """For each entry (a single load, or one per bin) the shard of each of its bins; and the shards' loads."""
    import numpy as np

    vectors: list = []
    heap: list[tuple[int, int]] = []
    children: list[tuple[int, int, np.ndarray, np.ndarray] | None] = []
    for i, x in enumerate(loads):
        v = np.zeros(shards, np.int64)
        if isinstance(x, int):
            v[-1] = x
        else:
            v[: len(x)] = x
        order = np.argsort(v, kind="stable")
        vectors.append(v[order])
        children.append((i, -1, order, order))
        heap.append((int(vectors[i][0]) - int(vectors[i][-1]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = vectors[a] + vectors[b][::-1]
        vectors[a] = vectors[b] = None
        order = np.argsort(v, kind="stable")
        vectors.append(v[order])
        children.append((a, b, order, order))
        heapq.heappush(heap, (int(v[order[0]]) - int(v[order[-1]]), len(vectors) - 1))
    if not loads:
        return [], [0] * shards
    where = {len(vectors) - 1: np.arange(shards)}
    out: list = [None] * len(loads)
    for node in range(len(vectors) - 1, -1, -1):
        a, b, order, _ = children[node]
        at = where.pop(node)  # at[k]: the shard of this vector's k-th load in ascending order
        place = np.empty(shards, np.int64)
        place[order] = at
        if b == -1:
            out[a] = place
        else:
            where[a], where[b] = place, place[::-1]
    final = vectors[-1]
    return [[int(p[-1])] if isinstance(x, int) else p[: len(x)].tolist() for x, p in zip(loads, out, strict=True)], final.tolist()


def _blocks(groups: DataFrame, shards: int) -> DataFrame:
    """Difference the groups of each block: rows (h, crc, size, block, bin), and one row (block, loads) a block."""

    def run(batches):
        from pyspark import TaskContext

        part, made, kept = TaskContext.get().partitionId(), 0, []

        def settle():
            nonlocal made, kept
            bins, _ = differenced([x[3] for x in kept], shards)
            block, sums = part << 32 | made, [0] * shards
            for x, b in zip(kept, bins, strict=True):
                sums[b[0]] += x[3]
            out = {"h": [x[0] for x in kept], "crc": [x[1] for x in kept], "size": [x[2] for x in kept], "block": [block] * len(kept), "bin": [b[0] for b in bins], "loads": [None] * len(kept)}
            made, kept = made + 1, []
            return {k: v + [{"block": block, "loads": sums}.get(k)] for k, v in out.items()}

        for cols in batches:
            for x in zip(cols["h"], cols["crc"], cols["size"], cols["bytes"], strict=True):
                kept.append(x)
                if len(kept) == BLOCK:
                    yield settle()
        if kept:
            yield settle()

    return map_batches(groups, run, "h long, crc long, size long, block long, bin int, loads array<long>")


def _merged(spark: SparkSession, sums: DataFrame, shards: int) -> DataFrame:
    """The shard of each (block, bin). Few blocks are settled on the driver, many by FAN at a time first."""
    n = sums.count()
    if n > FAN:
        out = "block long, bins array<int>, top long, loads array<long>"

        def run(key, rows):
            import pandas as pd

            rows = rows.sort_values("block")
            bins, _ = differenced([tuple(x) for x in rows.loads], shards)
            total = [0] * shards
            for b, x in zip(bins, rows.loads, strict=True):
                for to, load in zip(b, x, strict=True):
                    total[to] += int(load)
            return pd.concat([pd.DataFrame({"block": rows.block, "bins": bins, "top": key[0], "loads": None}), pd.DataFrame({"block": [None], "bins": [None], "top": [key[0]], "loads": [total]})])

        ranked = sums.repartitionByRange("block").withColumn("top", F.pmod(F.xxhash64("block"), F.lit(-(-n // (FAN // 2)))))
        lower = stored(ranked.groupBy("top").applyInPandas(run, out), "merged")
        upper = _merged(spark, lower.filter("loads is not null").select(F.col("top").alias("block"), "loads"), shards)
        low = lower.filter("bins is not null").select("block", "top", F.posexplode("bins").alias("bin", "via"))
        return low.join(upper.select(F.col("block").alias("top"), F.col("bin").alias("via"), "shard"), ["top", "via"]).select("block", "bin", "shard")
    vectors = sorted((r.block, tuple(r.loads)) for r in sums.collect())  # FAN vectors at most
    bins, _ = differenced([v for _, v in vectors], shards)
    rows = [(block, i, s) for (block, _), own in zip(vectors, bins, strict=True) for i, s in enumerate(own)]
    return spark.createDataFrame(rows, "block long, bin int, shard int")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: equal texts together, slots without gaps from 0 in each shard."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = stored(docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).alias("text_crc32"), F.xxhash64(text, text.isNull()).alias("h")), "sizes")
    groups = rows.groupBy("h", F.col("text_crc32").alias("crc"), "size").agg(F.sum("size").alias("bytes"))
    settled = stored(_blocks(groups.sortWithinPartitions("h", "crc", "size"), shards), "blocks")
    to = _merged(spark, settled.filter("loads is not null").select("block", "loads"), shards)
    homes = settled.filter("loads is null").select("h", "crc", "size", "block", "bin").join(to, ["block", "bin"]).select("h", F.col("crc").alias("text_crc32"), "size", "shard")
    placed = stored(looked_up(rows, homes, ["h", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(partitions(spark))).cast("int").alias("part")), "placed")
    dropped(spark, rows)
    dropped(spark, settled)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id")
    return placed.withColumn("nth", F.row_number().over(own)).join(bases, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
