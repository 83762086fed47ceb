"""Near copies by SimHash fingerprints that differ in few bits.

A fingerprint is cut into blocks, more than the bits that may differ, so that near fingerprints agree on some
choice of blocks. Equal fingerprints are folded first; the rest meet on each choice of blocks, and the bits that
differ are counted. A meeting place with many fingerprints is divided by further bits: those left are cut into
blocks in the same way, again and again, until few enough can be left to differ. So no pair is lost, and no task
holds more than a bounded number of fingerprints, however many copies of one text there are.

Null and empty texts have the fingerprint zero and are linked like others. Repeated rows and ids are rows of their
own; a null id never names a component. Further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import aside, dropped, looked_up, map_batches, stored
from quoin.llm.components import components, forest

BITS, BLOCKS = 64, 6
#: Fingerprints that are compared with one another in one place.
PLACE = 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, size: int) -> list[bytes]:
    """Of the words between white spaces (ASCII ones), A-Z in lower case; fewer words than size: all of them."""
    w = (text or "").encode().translate(_LOWER).split()
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def fingerprint(parts: list[bytes]) -> int:
    """A bit for each bit of the shingles' XXH64 (seed 42) that over half of them have; as a signed integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not parts:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), 1 << 15):
        h = np.array([xxh64_intdigest(p, 42) for p in parts[at : at + (1 << 15)]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches):
        for cols in batches:
            yield {"doc_id": cols["doc_id"], "fp": [fingerprint(shingles(t, size)) for t in cols["text"]]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def parts_of(bits: list[int], n: int) -> list[int]:
    """bits dealt into n masks of about equal size."""
    step, out, at = divmod(len(bits), n), [], 0
    for i in range(n):
        to = at + step[0] + (i < step[1])
        out.append(sum(1 << b for b in bits[at:to]))
        at = to
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int, distance: int) -> list[int]:
    """Masks that keep mask and one of the blocks that the bits left over are cut into."""
    return [mask | m for m in parts_of([b for b in range(BITS) if not mask >> b & 1], distance + 1) if m]


def near_within(place: list[int], distance: int) -> list[tuple[int, int]]:
    """Links of few fingerprints, as stars: those reached from one another by steps of at most distance bits."""
    import numpy as np

    left = np.array(place, np.int64).view(np.uint64)
    pairs: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                pairs.extend((int(y), int(x.astype(np.int64))) for y in left[near].view(np.int64))
                front, left = np.concatenate([front, left[near]]), left[~near]
    return forest(pairs)


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) of a graph over fp whose components are those of all pairs that differ in at most distance bits."""
    blocks = parts_of(list(range(BITS)), BLOCKS)
    masks = [signed(sum(c)) for c in combinations(blocks, BLOCKS - distance)]
    rows = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = None
    while True:
        # the least and the greatest of two are both of them: most places are done without being gathered
        places = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
        places = stored(places, "places")
        pairs = places.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
        met = rows.join(places.filter("n > 2").select("mask", "key", "n"), ["mask", "key"])
        few = met.filter(F.col("n") <= PLACE).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))

        def run(batches):
            for cols in batches:
                out = {x for fps in cols["fps"] for x in near_within(sorted(fps), distance)}
                yield {"a": [x for x, _ in out], "b": [x for _, x in out]}

        pairs = pairs.unionAll(map_batches(few.select("fps"), run, "a long, b long"))
        found = pairs if found is None else found.unionAll(pairs)
        if places.filter(F.col("n") > PLACE).isEmpty():
            return found.distinct()

        def divide(batches):
            for cols in batches:
                out = [(signed(m), fp) for mask, fp in zip(cols["mask"], cols["fp"], strict=True) for m in finer(mask & (1 << 64) - 1, distance)]
                yield {"mask": [m for m, _ in out], "key": [m & fp for m, fp in out], "fp": [fp for _, fp in out]}

        # the same fingerprints may come by two ways to one place
        rows = stored(map_batches(met.filter(F.col("n") > PLACE).select("mask", "fp"), divide, "mask long, key long, fp long").distinct(), "divided")


def _classes(marked: DataFrame, first: Column, distance: int) -> DataFrame:
    """(fp, name): for every fingerprint, the least first (an aggregate) of all rows of its component."""
    distinct = stored(marked.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(distinct, distance))
    homes = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "homes")
    dropped(marked.sparkSession, distinct)
    names = homes.groupBy("root").agg(F.min("first").alias("name"))
    return looked_up(homes.select("fp", "root"), names, ["root"]).select("fp", "name")


def near_copies(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most distance bits."""
    marked = stored(fingerprints(docs, size), "fingerprints")
    named = _classes(marked, F.min("doc_id"), distance)
    return looked_up(marked, named, ["fp"]).select("doc_id", "fp", F.col("name").alias("component_id"))


def representatives(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """One row of docs of each component: that of the smallest doc_id (rows without id come last), the first of equal ones."""
    known, back = aside(docs)
    rows = stored(known.withColumn("row", F.monotonically_increasing_id()), "rows")
    marked = fingerprints(rows.select(F.col("row").alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "row")
    marked = stored(marked.join(rows.select("row", "doc_id"), "row"), "fingerprints")
    chosen = _classes(marked, F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")), distance).select(F.col("name.row").alias("row")).distinct()
    return back(rows.join(chosen, "row", "left_semi"))


def hexadecimal(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
