"""Remove what was already said: every byte inside a string of so many bytes that also starts earlier in the corpus.

Such strings are compared as suffixes cut to that length. Sorting all of them would move each byte a hundred times,
so suffixes are sampled where it loses nothing: each window of the text names its least hashed block of bytes, its
anchor, and equal windows name the same anchor at the same offset. A run is all neighbouring windows with one anchor.

1. Sampled splitters range-partition the runs by the anchor's hash and their place in the corpus. In sorted ranges,
   runs whose anchor has no other run hold nothing that is repeated. A hash only leaves runs out: nothing is removed
   for it.
2. The other runs become suffixes with what stands before them, range-partitioned by their leading bytes (the anchor). Each bucket is sorted by multikey quicksort, once by the bytes from the anchor on, once
   by those before it, backward; the lengths of common prefixes of neighbours tell which windows hold the same bytes,
   and all but the earliest of each class are seen.
3. An anchor with very many runs, or at the edge of a range of the first step, is divided into parts; the windows that
   are the earliest of their part are compared across the parts, by their bytes.

Null texts count as empty. Rows that share a doc_id are documents of their own, earlier ones those read earlier.
Texts under the length keep all; texts of any length are treated whole, very long ones in overlapping pieces. Further
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.common import bucketed, dropped, partitions, stored, swept
from quoin.llm.token_store import mixed

#: Bytes of a window and of an anchor; bytes of text, or suffixes, worked on together; runs of an anchor in one part.
LENGTH, ANCHOR = 100, 32
BUFFER, SORTED, CROWD = 1 << 20, 1 << 14, 4096


class Sampler:
    """Finds the runs of texts."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        import numpy as np

        self.length, self.anchor, self.reach = length, anchor, length - anchor + 1
        self.block = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)

    def runs(self, texts: list[bytes]):
        """(document, h, first window, further windows, anchor from the first window) as arrays."""
        import numpy as np

        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        if n < self.length:
            return (np.zeros(0, np.int64),) * 5
        h, size, factor = self.block[raw], 1, 0x5851F42D4C957F2D
        while size < self.anchor:
            h = h[:-size] * np.uint64(factor & (1 << 64) - 1) + h[size:]
            size, factor = 2 * size, factor * factor & (1 << 64) - 1
        h = mixed(h)
        # the least of each window, leftmost on ties: widths are doubled, then two are laid over each other
        least, at, width = h, np.zeros(len(h), np.uint8), 1
        while width < self.reach:
            step = min(width, self.reach - width)
            right = least[step:] < least[:-step]
            at = np.where(right, at[step:] + np.uint8(step), at[:-step])
            least = np.minimum(least[step:], least[:-step])
            width += step
        windows = n - self.length + 1
        at = at[:windows].astype(np.int64)
        places = np.arange(windows)
        where = places + at
        document = np.repeat(np.arange(len(texts)), sizes)[:windows]
        inside = places + self.length <= ends[document]
        new = np.ones(windows, bool)
        new[1:] = (where[1:] != where[:-1]) | (document[1:] != document[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        if not len(first):
            return (np.zeros(0, np.int64),) * 5
        # a run ends before the next one or where windows leave the document
        stop = np.minimum(np.append(first[1:], windows), ends[document[first]] - self.length + 1)
        owner = document[first]
        return owner, h[where[first]].view(np.int64), first - (ends - sizes)[owner], stop - 1 - first, at[first]


def _numpy(batch: pa.RecordBatch, names: str):
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in names.split()]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces that overlap so far that each window is in exactly one."""
    for at in range(0, max(1, len(text) - LENGTH + 1), BUFFER):
        yield at, text[at : at + BUFFER + LENGTH - 1]


def ranges_of(splitters: list[tuple], h, *place):
    """For each key (h, and its place in the corpus) the number of splitters that it isn't under."""
    import numpy as np

    heads = np.array([s[0] for s in splitters], np.int64)
    at, to = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
    for k in np.flatnonzero(at < to).tolist():
        at[k] = bisect_right(splitters, (int(h[k]), *(int(c[k]) for c in place)), at[k], to[k])
    return at


def _splitters(texts: DataFrame, n: int) -> list[tuple]:
    """Keys that part the runs into n ranges of about equal size, by the runs of a sample of the texts."""
    texts = texts.sample(min(1.0, 16 * n / max(1, texts.count())), seed=20)
    keys = sorted(map(tuple, _sampled(texts, []).select("h", "doc_id", "row", "place").sample(0.1, seed=20).collect()))
    return [keys[k * len(keys) // n] for k in range(1, n)] if keys else []


def _sampled(docs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """(h, doc_id, row, place, bucket): place holds first window, further windows and the anchor's offset; bucket is the key's range."""
    schema = pa.schema([*((k, pa.int64()) for k in ("h", "doc_id", "row", "place")), ("bucket", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sampler = Sampler()

        def told(texts, ids, rows, starts):
            owner, h, first, more, at = sampler.runs(texts)
            first = first + np.array(starts, np.int64)[owner]
            columns = h, np.array(ids, np.int64)[owner], np.array(rows, np.int64)[owner], first << 16 | more << 8 | at
            return _batch(schema, *columns, ranges_of(splitters, *columns))

        for batch in batches:
            texts, ids, rows, starts, size = [], [], [], [], 0
            for k in range(batch.num_rows):
                text = batch.column("raw")[k].as_py() or b""
                if len(text) < LENGTH:
                    continue
                doc_id, row = batch.column("doc_id")[k].as_py(), batch.column("row")[k].as_py()
                for at, piece in _pieces(text):
                    texts.append(piece)
                    ids.append(doc_id)
                    rows.append(row)
                    starts.append(at)
                    size += len(piece)
                    if size >= BUFFER:
                        yield told(texts, ids, rows, starts)
                        texts, ids, rows, starts, size = [], [], [], [], 0
            if texts:
                yield told(texts, ids, rows, starts)

    return docs.mapInArrow(run, "h long, doc_id long, row long, place long, bucket int")


def _met(runs: DataFrame) -> DataFrame:
    """(part, doc_id, row, place) of those sorted runs whose anchor has others.

    part is 0, or a number of its own for at most CROWD runs of an anchor that has more, or that goes on (for all that
    is seen here) in another bucket. No more than CROWD runs and a batch are held.
    """
    schema = pa.schema([(k, pa.int64()) for k in ("part", "doc_id", "row", "place")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() + 1 << 32
        held = None  # runs of the last anchor
        before = 0  # runs told or left out
        going = None  # the hash of an anchor that is divided already: the bucket's first, or one of very many runs

        def told(columns, before, closing):
            h = columns[0]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(h)))
            divided = (size > CROWD) | (h[start] == going)
            divided[-1] |= closing
            size, divided = np.repeat(size, size), np.repeat(divided, size)
            part = np.where(divided, base + (before + np.arange(len(h))) // CROWD, 0)
            kept = divided | (size > 1)
            return _batch(schema, part[kept], *(c[kept] for c in columns[1:]))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _numpy(batch, "h doc_id row place")
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            h = columns[0]
            going = h[0] if going is None else going
            last = np.searchsorted(h, h[-1])
            if len(h) - last > CROWD:
                yield told(columns, before, False)
                before, held, going = before + len(h), None, h[-1]
                continue
            if last:
                yield told([c[:last] for c in columns], before, False)
            before, held = before + last, [c[last:] for c in columns]
        if held is not None:
            yield told(held, before, True)

    return runs.mapInArrow(run, "part long, doc_id long, row long, place long")


def multikey_quicksort(words, order, depth: int = 0) -> list:
    """Classes of equal rows of words (unsigned, one row a column of the key), in ascending order of their rows.

    Rows of order are parted by one word of the key into less, equal and greater; the equal ones go on to the next.
    """
    import numpy as np

    out, todo = [], [(order, depth)]
    big = words.astype(">u8")  # bytes in the order of the words
    while todo:
        order, depth = todo.pop()
        if len(order) == 1 or depth == words.shape[1]:
            out.append(order)
            continue
        if len(order) < 64:
            # few: one comparison sort of what is left of the key
            keys = [big[i, depth:].tobytes() for i in order.tolist()]
            rank = sorted(range(len(keys)), key=keys.__getitem__)
            start = 0
            for k in range(1, len(rank) + 1):
                if k == len(rank) or keys[rank[k]] != keys[rank[start]]:
                    out.append(order[rank[start:k]])
                    start = k
            continue
        word = words[order, depth]
        pivot = np.sort(word[:: max(1, len(word) // 63)])[min(31, (len(word) - 1) // 2)]
        less, more = word < pivot, word > pivot
        for part, d in ((order[more], depth), (order[~less & ~more], depth + 1), (order[less], depth)):
            if len(part):
                todo.append((part, d))
    return out


def _sorted(group, rows):
    """Rows of bytes, group by group, in the order of multikey quicksort: each one's rank, and by rank the length of the
    prefix shared with the row before (-1 in another group)."""
    import numpy as np

    n = len(rows)
    words = np.column_stack([group.astype(np.uint64), rows.view(">u8").astype(np.uint64)])
    order = np.concatenate(multikey_quicksort(words, np.arange(n)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    unlike = rows[order[1:]] != rows[order[:-1]]
    shared = np.full(n, -1, np.int64)
    shared[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return rank, shared


def classes(group, spans: list[bytes], at, more) -> Iterator[tuple]:
    """(offset of the anchor, spans, whether each is the earliest): for each offset the spans with a window that has the
    anchor there, windows of one group with the same bytes as one class; spans are in order of the corpus by group.

    Windows are equal if so many bytes after the anchor and so many before it are: classes of both are ranges of the
    spans' sorted orders, cut where neighbours share less.
    """
    import numpy as np

    n, reach = len(spans), LENGTH - ANCHOR
    size = np.array([len(s) for s in spans], np.int64)
    raw = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    anchor = (np.cumsum(size) - size + at)[:, None]

    def rows(steps, there):
        return np.where(there, raw[np.where(there, anchor + steps, 0)], 0).astype(np.uint8)

    width = np.arange(-(-2 * reach // 8) * 8)[None, :]
    after, shared_after = _sorted(group, rows(ANCHOR + width, width < (size - at)[:, None] - ANCHOR))
    width = np.arange(-(-reach // 8) * 8)[None, :]
    ahead, shared_ahead = _sorted(group, rows(-1 - width, width < at[:, None]))
    for d in range(reach + 1):
        here = np.flatnonzero((d <= at) & (d >= at - more))
        if not len(here):
            continue
        same_after = np.cumsum(shared_after < reach - d)[after[here]]
        same_ahead = np.cumsum(shared_ahead < d)[ahead[here]]
        _, first = np.unique(same_after * (n + 1) + same_ahead, return_index=True)
        earliest = np.zeros(len(here), bool)
        earliest[first] = True
        yield d, here, earliest


def _settled(suffixes: DataFrame) -> DataFrame:
    """(key, row, doc_id, first, last) from suffixes sorted by anchor, part and place: ranges of windows that are seen
    (without key), and windows, with their bytes as key, that are the earliest of their kind in one part of a divided anchor."""
    schema = pa.schema([("key", pa.binary()), *((k, pa.int64()) for k in ("row", "doc_id", "first", "last"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[tuple] = []

        def told(columns):
            anchor, part, doc_id, row, first, at, spans = columns
            new = [True, *(anchor[k] != anchor[k - 1] or part[k] != part[k - 1] for k in range(1, len(spans)))]
            doc_id, row, first, at = (np.array(x, np.int64) for x in (doc_id, row, first, at))
            more = np.array([len(s) for s in spans], np.int64) - LENGTH
            seen = np.zeros((len(spans), LENGTH - ANCHOR + 3), np.int8)
            divided = np.array(part) > 0
            for d, here, earliest in classes(np.cumsum(new), spans, at, more):
                late = here[~earliest]
                seen[late, at[late] - d + 1] = 1
                edge = here[earliest & divided[here]]
                if len(edge):
                    offset = at[edge] - d
                    keys = [spans[x][o : o + LENGTH] for x, o in zip(edge.tolist(), offset.tolist(), strict=True)]
                    yield _batch(schema, keys, row[edge], doc_id[edge], first[edge] + offset, first[edge] + offset)
            # neighbours in one span become one range
            turns = np.diff(seen, axis=1)
            span, start = np.nonzero(turns == 1)
            end = np.nonzero(turns == -1)[1]
            yield _batch(schema, [None] * len(span), row[span], doc_id[span], first[span] + start, first[span] + end - 1)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("anchor", "part", "doc_id", "row", "first", "at", "span")]
            for r in zip(*columns, strict=True):
                if len(held) >= SORTED and r[:2] != held[-1][:2]:
                    yield from told(list(zip(*held, strict=True)))
                    held = []
                held.append(r)
        if held:
            yield from told(list(zip(*held, strict=True)))

    return suffixes.mapInArrow(run, "key binary, row long, doc_id long, first long, last long")


def _placed(docs: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The texts in buckets by row, so that what is found joins them without moving them again."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("raw"))
    return bucketed(rows, "row", "texts")


def _ranges(texts: DataFrame) -> DataFrame:
    """(row, first, last): ranges of windows that also start earlier; stored."""
    n = partitions(texts.sparkSession)
    place = ("doc_id", "row", "place")
    own = texts.select("doc_id", "row", "raw")
    runs = _sampled(own, _splitters(own, n)).repartitionById(n, F.col("bucket")).drop("bucket").sortWithinPartitions("h", *place)
    asked = _met(runs).groupBy("row").agg(F.collect_list(F.struct("part", "place")).alias("asked"))
    one = texts.join(asked.hint("shuffle_merge"), "row").select("row", "doc_id", "raw", F.explode("asked").alias("x"))
    span = F.expr(f"substring(raw, cast(shiftright(x.place, 16) as int) + 1, cast(shiftright(x.place, 8) & 255 as int) + {LENGTH})")
    cut = one.select("x.part", "doc_id", "row", F.shiftright("x.place", 16).alias("first"), F.col("x.place").bitwiseAND(F.lit(255)).alias("at"), span.alias("span"))
    spans = stored(cut.select(F.expr(f"substring(span, cast(at as int) + 1, {ANCHOR})").alias("anchor"), "part", "doc_id", "row", "first", "at", "span"), "spans")
    swept(texts.sparkSession)
    buckets = spans.repartitionByRange(n, "anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "row", "first")
    settled = stored(_settled(buckets), "settled")
    dropped(texts.sparkSession, spans)
    swept(texts.sparkSession)
    alike = Window.partitionBy("key").orderBy("doc_id", "row", "first")
    late = settled.filter("key is not null").withColumn("nth", F.row_number().over(alike)).filter("nth > 1")
    found = stored(settled.filter("key is null").select("row", "first", "last").unionAll(late.select("row", "first", "last")), "ranges")
    dropped(texts.sparkSession, settled)
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start,end>>, kept binary) of every row; removed runs don't touch. Computed when called."""
    texts, gone = _placed(docs)
    ranges = _ranges(texts)
    found = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("found"))
    joined = texts.join(found.hint("shuffle_merge"), "row", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, sizes = [], [], []
            for raw, ranges in zip(batch.column("raw").to_pylist(), batch.column("found").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for r in ranges or ():
                    start, end = r["first"], r["last"] + LENGTH
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                at, parts = 0, []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
            ids = [None if n else i for i, n in zip(batch.column("doc_id").to_pylist(), batch.column("nameless").to_pylist(), strict=True)]
            yield _batch(schema, ids, sizes, removed, kept)

    out = stored(joined.select("doc_id", "nameless", "raw", "found").mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"), "kept")
    dropped(docs.sparkSession, ranges)
    gone()
    return out
