"""Find benchmark items in documents by Wu-Manber search for many strings at once.

Documents and items become lower-case words between single spaces. A pattern is a window of so many item words,
with the spaces around it. Per pattern set, a shift table tells for each block of bytes how far the search may
move on; where it says zero, the block's bucket gives the patterns to compare byte by byte.

Null texts have no words; items without words have no windows. Rows are treated one by one, so repeated rows,
ties and very long texts need nothing special. Items that share an id count once; an item without id counts as
the empty id. With no items, nothing is hit. Columns of the documents other than those that find_items() and judged()
make are carried along; columns of those names are left out.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import dropped, map_batches, stored

#: Words of a window.
WINDOW = 13
#: Item text held by the driver, sent to the executors and made into tables (some 200 bytes for each of text) at once;
#: more items take further passes over the documents.
PASS_BYTES = 2 << 20
#: Bytes of a block, at most.
BLOCK = 10

#: A-Z to a-z, other ASCII than digits and a-z to a space; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not item:
        return []
    return [b" " + b" ".join(item[i : i + size]) + b" " for i in range(max(1, len(item) - size + 1))]


class WuManber:
    """Patterns of about one length: the shortest sets how far a search can move."""

    def __init__(self, patterns: list[bytes]):
        self.least = min(map(len, patterns))
        self.block = min(BLOCK, max(1, self.least // 2))
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.least + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.least), self.least - end)
            self.buckets[p[self.least - self.block : self.least]].append(p)
        self.far = self.least - self.block + 1

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence."""
        out, block, far, shift, least = [], self.block, self.far, self.shift.get, self.least
        end, size = least, len(text)
        while end <= size:
            if step := shift(text[end - block : end], far):
                end += step
                continue
            start = end - least
            for p in self.buckets[text[end - block : end]]:
                if text.startswith(p, start):
                    out.append((start, p))
            end += 1
        return out


class Searcher:
    """Splits patterns by length, so that short ones don't slow the search for long ones."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        for item_id, text in items:
            for p in windows(words(text), size):
                self.items[p].add(item_id)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for p in self.items:
            by_length[len(p).bit_length() if len(p) < 64 else 7].append(p)
        self.engines = [WuManber(ps) for _, ps in sorted(by_length.items())]
        self.n_words = {p: p.count(b" ") - 1 for p in self.items}

    def find(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges inside occurrences, and the items found."""
        text = b" " + b" ".join(document) + b" "
        found = [x for e in self.engines for x in e.search(text)]
        if not found:
            return [], set()
        starts = [0]
        for w in document:
            starts.append(starts[-1] + len(w) + 1)
        ranges = sorted({(at := bisect_right(starts, start) - 1, at + self.n_words[p]) for start, p in found})
        return ranges, set().union(*(self.items[p] for _, p in found))


def covered(ranges: list[tuple[int, int]]) -> int:
    n = reach = 0
    for a, b in sorted(ranges):
        n += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()


def pass_count(items: DataFrame, limit: int) -> int:
    """So many passes that the items of each, dealt by hash, hold about half of limit."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    return max(1, -(-2 * total // limit)) if total > limit else 1


def items_of_pass(items: DataFrame, k: int, n: int) -> list[tuple[str, str]]:
    """The items of one pass, collected now."""
    return [(r.i, r.t) for r in (items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()]


@contextmanager
def sent(spark: SparkSession, items: list[tuple[str, str]]) -> Iterator[Broadcast]:
    """items on the executors for as long as they are needed."""
    shared = spark.sparkContext.broadcast(items)
    try:
        yield shared
    finally:
        shared.destroy()


_kept: dict[str, Searcher] = {}


def _searcher(name: str, items: Broadcast, size: int) -> Searcher:
    """One searcher a worker: that of the last pass asked for."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Searcher(items.value, size)
    return _kept[name]


def _found(name: str, items: Broadcast, size: int, texts: list[str | None]) -> tuple[list, list, list]:
    """Number of words, ranges of words hit and ids of items, by text."""
    search = _searcher(name, items, size)
    n, ranges, found = [], [], []
    for t in texts:
        document = words(t)
        r, i = search.find(document)
        n.append(len(document))
        ranges.append([{"start": a, "end": b} for a, b in r])
        found.append(sorted(i))
    return n, ranges, found


MADE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_ranges", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("found", T.ArrayType(T.StringType())),
])


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "item_id", item_text: str = "text", size: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """docs (without the text, if it isn't kept) with n_words long, hit_ranges array<struct<start,end>> of words, and found array<string>, the items' ids, sorted.

    Where the items take several passes, each is collected, sent, searched for and forgotten before the next; a pass
    stores the rows that it hits (the first one all, with their number of words), and these are joined at the end.
    """
    spark = docs.sparkSession
    kept = [f for f in docs.schema if f.name not in MADE.names]
    gone = set() if keep_text else {text}
    items = _items(benchmark, id_col, item_text)
    passes = pass_count(items, PASS_BYTES)
    if passes == 1:
        shared, name = spark.sparkContext.broadcast(items_of_pass(items, 0, 1)), uuid.uuid4().hex

        def run(batches):
            for cols in batches:
                made = zip(MADE.names, _found(name, shared, size, cols[text]), strict=True)
                yield {c: v for c, v in cols.items() if c not in gone} | dict(made)

        return map_batches(docs.select(*(f.name for f in kept)), run, T.StructType([*(f for f in kept if f.name not in gone), *MADE]))

    rows = stored(docs.select(*(f.name for f in kept), F.monotonically_increasing_id().alias("_of_pass")), "documents")
    parts = []
    for k in range(passes):
        with sent(spark, items_of_pass(items, k, passes)) as shared:
            name = uuid.uuid4().hex

            def search(batches, k=k, name=name, shared=shared):
                for cols in batches:
                    made = zip(cols["_of_pass"], *_found(name, shared, size, cols[text]), strict=True)
                    told = [x for x in made if k == 0 or x[3]]
                    yield {c: [x[i] for x in told] for i, c in enumerate(("_of_pass", *MADE.names))} | ({} if k == 0 else {"n_words": [0] * len(told)})

            parts.append(stored(map_batches(rows.select("_of_pass", text), search, T.StructType([T.StructField("_of_pass", T.LongType()), *MADE])), "hits"))
    ranges, ids = F.flatten(F.collect_list("hit_ranges")), F.flatten(F.collect_list("found"))
    hits = reduce(DataFrame.unionAll, parts).groupBy("_of_pass").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.array_distinct(ranges)).alias("hit_ranges"), F.array_sort(F.array_distinct(ids)).alias("found"))
    merged = stored(hits, "merged")
    for part in parts:
        dropped(spark, part)
    return rows.join(merged, "_of_pass").select(*(f.name for f in kept if f.name not in gone), *MADE.names)


def judged(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """find_items() with n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more is hit)."""
    found = find_items(docs, benchmark, **names)
    merged = F.aggregate("hit_ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")), lambda a, x: F.struct((a.n + F.greatest(F.lit(0).cast("long"), x.end - F.greatest(x.start, a.reach))).alias("n"), F.greatest(a.reach, x.end).alias("reach")))
    out = found.withColumn("n_hit", merged.n).withColumn("n_items", F.size("found").cast("long")).withColumn("items_sha256", F.sha2(F.concat_ws(",", "found"), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
