"""Repair the structure of conversations by the cheapest edits that make the roles follow `(s?(ua)+)?`.

Edits form a lattice of nodes (rows read, state of the grammar). Dijkstra's search goes over it without building it, in
the order of (cost, audit), and stops at the first node popped that is an accepting end. Audits of one node that cost the
same are never prefixes of each other (the longer one would have more insertions, which cost), so the least one of a
node stays the least one whatever follows.

A conversation may hold a third of all rows, so rows are sorted into ranges by conversation and turn, and each range is
cut into sections of bounded size. A section that is a whole conversation is repaired at once. For any other, the search
runs from each state it may be entered in to each it may be left in; the sections' costs and audits are then put
together in order, and the digest of what was chosen is made by reading the sections one after the other.

Nulls in role and text are one space, as in the damage's key. Rows of a conversation are ordered by turn, nulls first,
then by role and text, so ties and repeated rows have a place; rows that are the same in all four columns are counted
before they are moved. A null conv_id is a conversation of its own. A role whose initial isn't s, u or a (or that is
empty) can't be kept. Conversations of which no row is left have zeros. Other columns are ignored. The audit and the
digest of one conversation are values of one row, so the audits of one conversation meet in one task, and its repaired
text passes through one, in sections.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import fresh_path, looked_up, map_batches, partitions, scratch, stored

#: Rows of a section, and characters of their texts (one row may have more).
ROWS, CHARS = 256, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State of the grammar (empty, after s, after u, after a), and where a role's initial leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
#: Initials that may follow each other.
PAIRS = ("su", "ua", "au")
#: A row's faults.
CLEAN, CUT, BLANK, DUPLICATE = 0, 1, 2, 3


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of what the damage leaves of each row: by crc32 of `conv_id:turn` % 20."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hurt = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20).alias("hurt"))
    text = F.when(F.col("hurt") == 1, F.lit("")).when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, F.lit("user")).otherwise(F.col("role"))
    return hurt.filter("hurt <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hurt") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _order(turn: Column) -> Column:
    """Nulls first."""
    return F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"))


def faulty(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies), same rows put together, with the fault of the first copy of each; further copies are duplicates, or blank."""
    chars = F.lit(" \t\n\x0b\x0c\r")
    core = F.rtrim(F.col("text"), chars)
    fault = F.when(core == "", BLANK).when(F.substring(core, -1, 1).isin(".", "!", "?"), CLEAN).otherwise(CUT)
    said = F.sha2(F.encode(F.concat_ws(":", F.char_length("role"), "role", "text"), "UTF-8"), 256)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull()
    own = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("fault", fault).withColumn("said", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)), said.alias("digest"))), "rows")
    again = own.filter(F.col("fault") != BLANK).groupBy("said").agg(F.min(_order(F.col("turn"))).alias("first"), F.count("*").alias("n")).filter("n > 1").select("said", "first")
    told = looked_up(own, again, ["said"], "left")
    repeated = (F.col("fault") != BLANK) & F.col("first").isNotNull() & (F.col("first") < _order(F.col("turn")))
    return told.select("conv_id", "turn", "role", "text", "copies", F.when(repeated, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


Row = tuple[int | None, str, str, int, int]  # turn, role, text, copies, fault


def searched(rows: list[Row], start: int, ends: tuple[int, ...] | None) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the cheapest ways from start over all rows: the first of ends reached, or to every state (None)."""
    steps = []
    for _, role, _, copies, fault in rows:
        further = copies - 1
        steps.append((role[:1], fault in (BLANK, DUPLICATE), fault == CUT, DELETE * further, "D" * further))
    size, done, found = len(steps), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == size:
            if ends is None:
                found[state] = cost, audit
                if len(found) == len(NEXT):
                    break
            elif state in ends:
                return {state: (cost, audit)}
        for initial, to in NEXT[state].items():
            if initial in ROLE and (at, to) not in done:
                heappush(heap, (cost + INSERT, audit + "I", at, to))
        if at < size:
            initial, bad, cut, more, letters = steps[at]
            heappush(heap, (cost + DELETE + more, audit + "D" + letters, at + 1, state))
            if not bad:
                loss = TRUNCATED * cut + more
                if initial in NEXT[state]:
                    heappush(heap, (cost + KEEP + loss, audit + "K" + letters, at + 1, NEXT[state][initial]))
                for other, to in NEXT[state].items():
                    if other in ROLE:
                        heappush(heap, (cost + REROLE + loss, audit + "R" + letters, at + 1, to))
    return found


def edited(rows: Iterable[tuple[str, str, int]], audit: str, state: int, end: int | None) -> Iterator[str]:
    """`role:text` of what the audit makes of rows (role, text, copies), entered in state. end: None, or the state to be left in.

    The audit doesn't say which role an inserted or changed row gets, but the grammar does: one that isn't s is u but after u.
    """
    letters, at, it = audit, 0, iter(rows)
    while at < len(letters):
        letter = letters[at]
        if letter == "I":
            state = 3 if state == 2 else 2
            yield f"{ROLE['a' if state == 3 else 'u']}:"
            at += 1
            continue
        role, text, copies = next(it)
        if letter == "K":
            state = NEXT[state][role[:1]]
            yield f"{role}:{text}"
        elif letter == "R":
            state = 3 if state == 2 else 2
            yield f"{ROLE['a' if state == 3 else 'u']}:{text}"
        at += copies
    assert end is None or state == end


def _known(rows: list[Row]) -> dict:
    """What a section tells of itself."""
    turns = [r[0] for r in rows if r[0] is not None]
    counts = {BLANK: 0, DUPLICATE: 0, CUT: 0}
    illegal = 0
    for _, role, _, copies, fault in rows:
        counts[fault] = counts.get(fault, 0) + 1
        counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        illegal += (copies - 1) * (role[:1] + role[:1] not in PAIRS)
    for (_, a, *_), (_, b, *_) in zip(rows, rows[1:], strict=False):
        illegal += a[:1] + b[:1] not in PAIRS
    return {"least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)), "blank": counts[BLANK], "duplicate": counts[DUPLICATE], "truncated": counts[CUT], "illegal": illegal, "head": rows[0][1][:1], "tail": rows[-1][1][:1]}


def _joined(a: dict, b: dict) -> dict:
    """Of two sections, one after the other."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += a["tail"] + b["head"] not in PAIRS
    out["turns"] = a["turns"] + b["turns"] - (a["most"] is not None and a["most"] == b["least"])
    out["least"] = a["least"] if a["least"] is not None else b["least"]
    out["most"] = b["most"] if b["most"] is not None else a["most"]
    out["head"], out["tail"] = a["head"], b["tail"]
    return out


TOLD = "least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
WAYS = "ways array<struct<enter: int, leave: int, cost: long, audit: string>>"
PARTS = f"conv_id string, unnamed boolean, part long, whole boolean, {TOLD}, {WAYS}, digest string, rows array<struct<role: string, text: string, copies: long>>"


def _names(schema: str) -> list[str]:
    """The columns of a schema, without what is nested in them."""
    while "<" in schema:
        schema = re.sub("<[^<>]*>", "", schema)
    return [part.split()[0] for part in schema.replace(":", " ").split(",")]


def _sections(batches, most_rows: int, most_chars: int) -> Iterator[dict[str, list]]:
    """The sections of one range of sorted rows. The first and the last conversation of a range may go on in others."""
    names = _names(PARTS)

    def told(conv, number: int, rows: list[Row], alone: bool) -> dict[str, list]:
        known = _known(rows)
        if alone:
            ((state, (cost, audit)),) = searched(rows, 0, ACCEPTING).items()
            text = "\n".join(edited((r[1:4] for r in rows), audit, 0, state))
            ways, digest, kept = [{"enter": 0, "leave": state, "cost": cost, "audit": audit}], hashlib.sha256(text.encode()).hexdigest(), None
        else:
            ways = [{"enter": s, "leave": e, "cost": c, "audit": a} for s in range(len(NEXT)) for e, (c, a) in sorted(searched(rows, s, None).items())]
            digest, kept = None, [{"role": r, "text": t, "copies": c} for _, r, t, c, _ in rows]
        values = {**known, "conv_id": conv[0], "unnamed": conv[1], "part": number, "whole": alone, "ways": ways, "digest": digest, "rows": kept}
        return {n: [values[n]] for n in names}

    conv, rows, chars, first, cut, number = None, [], 0, True, False, 0
    for cols in batches:
        for k, unnamed, turn, role, text, copies, fault in zip(*(cols[c] for c in ("conv_id", "unnamed", "turn", "role", "text", "copies", "fault")), strict=True):
            other = conv is not None and (k, unnamed) != conv
            if rows and (other or len(rows) >= most_rows or chars + len(text) > most_chars):
                yield told(conv, number, rows, other and not first and not cut)
                rows, chars, number, first, cut = [], 0, number + 1, first and not other, not other
            conv = k, unnamed
            rows.append((turn, role, text, copies, fault))
            chars += len(text)
    if rows:
        yield told(conv, number, rows, False)


def _chosen(batches) -> Iterator[dict[str, list]]:
    """Of each conversation's sections, in order: which way each is taken, and what the first row tells of them all."""
    names = _names(CHOSEN)

    def told(conv, held: list[dict]) -> dict[str, list]:
        known = held[0]
        for x in held[1:]:
            known = _joined(known, x)
        # the cheapest cost from each state on, from the end
        ahead = {s: 0 for s in ACCEPTING}
        costs = [ahead]
        for x in reversed(held):
            ahead = {}
            for w in x["ways"]:
                if w["leave"] in costs[-1]:
                    ahead[w["enter"]] = min(ahead.get(w["enter"], 1 << 60), w["cost"] + costs[-1][w["leave"]])
            costs.append(ahead)
        costs.reverse()
        # audits of ways that cost the least, as far as they differ; back: how each state was come to
        live, back = {0: ""}, []
        for i, x in enumerate(held):
            then: dict[int, tuple[str, int, dict]] = {}
            for w in x["ways"]:
                if w["enter"] in live and w["leave"] in costs[i + 1] and w["cost"] + costs[i + 1][w["leave"]] == costs[i][w["enter"]]:
                    audit = live[w["enter"]] + w["audit"]
                    if w["leave"] not in then or audit < then[w["leave"]][0]:
                        then[w["leave"]] = audit, w["enter"], w
            back.append({s: (e, w) for s, (_, e, w) in then.items()})
            audits = [a for a, _, _ in then.values()]
            same = len(audits[0]) if len(audits) == 1 else _shared(audits)
            live = {s: a[same:] for s, (a, _, _) in then.items()}
        state, ways = min(live, key=live.get), []
        for steps in reversed(back):
            state, w = steps[state]
            ways.append(w)
        ways.reverse()
        out: dict[str, list] = {n: [] for n in names}
        for i, (x, w) in enumerate(zip(held, ways, strict=True)):
            values = {**(known if i == 0 else dict.fromkeys(known)), "conv_id": conv[0], "unnamed": conv[1], "part": x["part"], "enter": w["enter"], "leave": w["leave"], "cost": w["cost"], "audit": w["audit"]}
            for n in names:
                out[n].append(values[n])
        return out

    conv, held = None, []
    for cols in batches:
        keys = list(cols)
        for values in zip(*cols.values(), strict=True):
            x = dict(zip(keys, values, strict=True))
            if held and (x["conv_id"], x["unnamed"]) != conv:
                yield told(conv, held)
                held = []
            conv = x["conv_id"], x["unnamed"]
            held.append(x)
    if held:
        yield told(conv, held)


def _shared(texts: list[str]) -> int:
    """Length of the common prefix."""
    a, b = min(texts), max(texts)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


CHOSEN = f"conv_id string, unnamed boolean, part long, {TOLD}, enter int, leave int, cost long, audit string"
MADE = f"conv_id string, unnamed boolean, {TOLD}, cost long, audit string, digest string"


def _digested(batches) -> Iterator[dict[str, list]]:
    """A row for each conversation of sorted sections with the way that was chosen; texts go through one by one."""
    names = _names(MADE)
    conv, known, cost, audits, digest, any_text = None, None, 0, [], None, False

    def told() -> dict[str, list]:
        values = {**known, "conv_id": conv[0], "unnamed": conv[1], "cost": cost, "audit": "".join(audits), "digest": digest.hexdigest()}
        return {n: [values[n]] for n in names}

    for cols in batches:
        keys = list(cols)
        for values in zip(*cols.values(), strict=True):
            x = dict(zip(keys, values, strict=True))
            if (x["conv_id"], x["unnamed"]) != conv:
                if conv is not None:
                    yield told()
                conv, known, cost, audits, digest, any_text = (x["conv_id"], x["unnamed"]), x, 0, [], hashlib.sha256(), False
            cost += x["cost"]
            audits.append(x["audit"])
            for line in edited(((r["role"], r["text"], r["copies"]) for r in x["rows"]), x["audit"], x["enter"], x["leave"]):
                digest.update(b"\n" * any_text + line.encode())
                any_text = True
    if conv is not None:
        yield told()


def repaired(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text, copies) that has any: conv_id and unnamed (whether it is null), TOLD, cost, audit and digest."""
    spark = rows.sparkSession
    n = partitions(spark)
    ready = stored(faulty(rows).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("conv_id").isNull().alias("unnamed"), "turn", "role", "text", "copies", "fault"), "faulty")
    order = ["unnamed", "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    ranges = ready.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sections = stored(map_batches(ranges, lambda b: _sections(b, most_rows, most_chars), PARTS).withColumn("part", F.struct(F.spark_partition_id().alias("range"), F.col("part").alias("number"))), "sections")
    whole = sections.filter("whole").select("conv_id", "unnamed", *_names(TOLD), F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"), "digest")
    at = ["unnamed", "conv_id", "range", "number"]
    cut = sections.filter(~F.col("whole")).select("*", "part.*").drop("part", "whole", "digest")
    by_conv = lambda df: df.repartition(n, "unnamed", "conv_id").sortWithinPartitions(*at)
    numbered = by_conv(cut.drop("rows")).withColumn("part", F.shiftleft(F.col("range").cast("long"), 40) + F.col("number")).drop("range", "number")
    chosen = stored(map_batches(numbered, _chosen, CHOSEN), "chosen")
    ways = chosen.withColumn("range", F.shiftright("part", 40).cast("int")).withColumn("number", F.col("part") - F.shiftleft(F.shiftright("part", 40), 40)).drop("part", "conv_id", "unnamed")
    texts = cut.select("unnamed", "conv_id", "range", "number", "rows").join(ways, ["range", "number"])
    return whole.unionByName(map_batches(by_conv(texts), _digested, MADE))


def judged(conversations: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """A row for each conv_id of conversations (conv_id, turn, role, text): what the damage did to it and what repairs it."""
    spark = conversations.sparkSession
    path = fresh_path(spark, "repaired")
    with scratch(spark, path):
        made = repaired(damaged(conversations), most_rows, most_chars)
        ids = conversations.select("conv_id").distinct().withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("_unnamed", F.col("conv_id").isNull())
        on = (F.col("_key") == made.conv_id) & (F.col("_unnamed") == made.unnamed)
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        counts = [zero(made[c]).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        gaps = zero(made.most - made.least + 1 - made.turns).alias("gaps")
        out = ids.join(made, on, "left").select(ids.conv_id, gaps, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
        out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
