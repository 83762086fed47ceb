"""Exact top-k by inner product over a bit-sliced index.

Candidates are indexed in blocks: for each component of the quantised vectors, one bitmap over the block's rows per
bit of its value. The index is stored, a row a block, and read for each batch of queries. The scores of a query over
a block are again a bit-sliced number: slices are added with bitmap arithmetic, a component's weight bit by bit. The
best rows are read off from the most significant slice downward; rows that tie at the border are told apart by id.
The best of all blocks are then merged. Queries are collected, sent, answered and forgotten a batch at a time; what
a batch found is stored before the next.

Vectors that are null or hold null, NaN or infinite components take no part; shorter vectors count as padded with
zeros. Rows with an equal vec_id are rows of their own: each is a query if its id is one, and a candidate of all
queries but itself. Rows without id take no part. Further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.common import dropped, map_batches, stored

#: Rows of an index block; queries sent out at once (4 MB of components for vectors of 64).
BLOCK_ROWS, BATCH = 16_384, 8192
SCALE = 64


def quantised(vectors: DataFrame, id_col: str, vector: str, is_query: Column) -> DataFrame:
    """(row, id, q array<long>, asked): floor(64 x) of each component of the usable vectors, and whether they are queries."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & sound)
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asked"))


class Block:
    """Slices of some rows; bitmaps are integers, bit r for the r-th row in order of id."""

    def __init__(self, rows: list[int], ids: list[int], least: list[int], slices: list[list[int]]):
        self.ids, self.least, self.slices = ids, least, slices
        self.all = (1 << len(ids)) - 1
        self.at = {row: 1 << r for r, row in enumerate(rows)}

    @classmethod
    def of(cls, rows: list[int], ids: list[int], vectors: list[list[int]]) -> Block:
        import numpy as np

        order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i]))
        width = max(map(len, vectors), default=0)
        values = np.zeros((len(ids), width), np.int64)
        for to, i in enumerate(order):
            values[to, : len(vectors[i])] = vectors[i]
        least = values.min(axis=0).tolist() if len(ids) else []
        slices: list[list[int]] = []
        for d in range(width):
            v = (values[:, d] - least[d]).astype(np.uint64)
            slices.append([int.from_bytes(np.packbits((v >> np.uint64(b)) & np.uint64(1) == 1, bitorder="little").tobytes(), "little") for b in range(int(v.max()).bit_length())])
        return cls([rows[i] for i in order], [ids[i] for i in order], least, slices)

    def stored(self) -> dict[str, list]:
        """As a row of the index."""
        size = -(-len(self.ids) // 8)
        return {"rows": [list(self.at)], "ids": [self.ids], "least": [self.least], "slices": [[[s.to_bytes(size, "little") for s in own] for own in self.slices]]}

    @classmethod
    def read(cls, cols: dict[str, list]) -> Iterator[Block]:
        for rows, ids, least, slices in zip(cols["rows"], cols["ids"], cols["least"], cols["slices"], strict=True):
            yield cls(rows, ids, least, [[int.from_bytes(s, "little") for s in own] for own in slices])

    def scores(self, query: list[int]) -> tuple[list[int], int]:
        """Slices of the scores, least significant first, and what is to be added to each."""
        base, columns = 0, []

        def put(place: int, bitmap: int) -> None:
            while len(columns) <= place:
                columns.append([])
            columns[place].append(bitmap)

        for w, least, own in zip(query, self.least, self.slices, strict=False):
            base += w * least
            if w < 0:  # w x = -w (top - x) + w top, and top - x has the slices of x reversed
                base += w * ((1 << len(own)) - 1)
                own, w = [self.all ^ s for s in own], -w
            while w:
                low = (w & -w).bit_length() - 1
                for b, s in enumerate(own):
                    put(b + low, s)
                w &= w - 1
        out = []
        place = 0
        while place < len(columns):
            column = columns[place]
            while len(column) > 2:  # three bitmaps of one place make one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                either = a ^ b
                column.insert(0, either ^ c)
                put(place + 1, a & b | either & c)
            if len(column) == 2:
                a, b = column
                put(place + 1, a & b)
                column = [a ^ b]
            out.append(column[0] if column else 0)
            place += 1
        return out, base

    def best(self, row: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the query's own, ties to smaller ids."""
        slices, base = self.scores(query)
        sure, border = 0, self.all & ~self.at.get(row, 0)
        for s in reversed(slices):
            if (n := ((more := border & s) | sure).bit_count()) > k:
                border = more
            else:
                sure |= more
                border &= ~s
                if n == k:
                    border = 0
                    break
        rows = []
        for bitmap, most in ((sure, k), (border, k - sure.bit_count())):
            while bitmap and most > 0:
                low = bitmap & -bitmap
                bitmap ^= low
                most -= 1
                r = low.bit_length() - 1
                rows.append((self.ids[r], base + sum((s >> r & 1) << b for b, s in enumerate(slices))))
        return sorted(rows, key=lambda x: (-x[1], x[0]))


def indexed(vectors: DataFrame) -> DataFrame:
    """A row (rows, ids, least, slices) for each block of quantised vectors (row, id, q)."""

    def run(batches):
        rows: list[int] = []
        ids: list[int] = []
        kept: list[list[int]] = []
        for cols in batches:
            for row, own, q in zip(cols["row"], cols["id"], cols["q"], strict=True):
                rows.append(row)
                ids.append(own)
                kept.append(q)
                if len(ids) == BLOCK_ROWS:
                    yield Block.of(rows, ids, kept).stored()
                    rows, ids, kept = [], [], []
        if ids:
            yield Block.of(rows, ids, kept).stored()

    return map_batches(vectors.select("row", "id", "q"), run, "rows array<long>, ids array<long>, least array<long>, slices array<array<binary>>")


def answered(index: DataFrame, queries: list[tuple[int, int, list[int]]], k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the best of all blocks for each of the queries (row, id, q); stored."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for cols in batches:
            for block in Block.read(cols):
                for at in range(0, len(shared.value), 256):
                    found = [(row, query_id, *x) for row, query_id, q in shared.value[at : at + 256] for x in block.best(row, q, k)]
                    yield {name: [x[i] for x in found] for i, name in enumerate(("row", "query_id", "vec_id", "score"))}

    of_all = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    found = map_batches(index, run, "row long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(of_all))
    out = stored(found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "answers")
    shared.destroy()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row among all others. Computed when called."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector, is_query), "quantised")
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).head()
    # blocks are full however the input was cut, and as many tasks work as there are blocks
    index = stored(indexed(rows.repartition(max(1, -(-total // BLOCK_ROWS)))), "index")
    batches, out = max(1, -(-asked // BATCH)), []
    for at in range(batches):
        batch = rows.filter("asked") if batches == 1 else rows.filter("asked").filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == at)
        out.append(answered(index, [(r.row, r.id, r.q) for r in batch.select("row", "id", "q").collect()], k))
    dropped(spark, rows)
    dropped(spark, index)
    return reduce(DataFrame.unionAll, out)
