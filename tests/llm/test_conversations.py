"""Repaired conversations against a search of all edits, and the query against its SQL."""

import itertools
import random
import re
import zlib

import duckdb
import pytest

from quoin.llm import conversations, queries
from tests.llm.helpers import frame, sha

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) by trying, row by row, every edit and up to two insertions before it."""
    ways = {"": (0, "", [])}  # by initials so far, of which pairs may be left out
    nothing = [((), 0, "")]
    inserts = [*nothing, *(((r,), 2, "I") for r in ("user", "assistant")), *(((a, b), 4, "II") for a, b in itertools.product(("user", "assistant"), repeat=2))]

    def grown(ways, options):
        out = {}
        for initials, (cost, audit, lines) in ways.items():
            for added, price, letters in options:
                said = initials + "".join(role[:1] for role, _ in added)
                parts = re.fullmatch("(s?)((?:ua)*)(u?)", said)
                if not parts:
                    continue
                key = parts[1] + ("ua" if parts[2] else "") + parts[3]
                way = cost + price, audit + letters, [*lines, *(f"{r}:{t}" for r, t in added)]
                if key not in out or way[:2] < out[key][:2]:
                    out[key] = way
        return out

    for role, text, fault in rows:
        ways = grown(ways, [([(r, "") for r in added], price, letters) for added, price, letters in inserts])
        loss = fault == "truncated"
        options = [([], 3, "D")]
        if fault not in ("blank", "duplicate"):
            options += [([(role, text)], loss, "K")] * bool(role[:1]) + [([(r, text)], 2 + loss, "R") for r in ("user", "assistant")]
        ways = grown(ways, options)
    ways = grown(ways, [([(r, "") for r in added], price, letters) for added, price, letters in inserts])
    return min((way for initials, way in ways.items() if re.fullmatch("(s?(ua)+)?", initials)), key=lambda w: w[:2])


def expected(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            show = lambda x: " " if x is None else str(x)
            hurt = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
            role, text = show(role), show(text)
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hurt, text)
            rows += [(turn, "user" if hurt == 4 else role, text)] * {0: 0, 3: 2}.get(hurt, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in rows:
            core = text.rstrip(BLANK)
            judged.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        faults = [f for *_, f in judged]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = cheapest(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def table(seed=3):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "No!", "well", None, "", " \n", "What? ", "é ", "a longer answer."]
    rows = []
    for conv in [*range(120), None]:
        tidy = rng.random() < 0.5
        for turn in range(rng.randint(1, 12)):
            role = ("user", "assistant")[turn % 2] if tidy and rng.random() < 0.8 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(texts)))
    long = [(500, i, rng.choice(roles), f"said {i % 60}{rng.choice(['.', ''])}") for i in range(700)]
    return [*rows, *rows[:40], *long, *[(501, i, "tool", f"{i}.") for i in range(300)], *[(502, 7, "user", "Same.")] * 90, *[(503, None, "user", "Hi.")] * 3]


@pytest.mark.parametrize(("most_rows", "most_chars"), [(conversations.ROWS, conversations.CHARS), (3, 1000), (40, 90)])
def test_repairs_are_the_cheapest(spark, most_rows, most_chars):
    rows = table()
    docs = frame(spark, [(*r, "x") for r in rows], SCHEMA + ", audit string")
    got = conversations.judged(docs, most_rows, most_chars)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {"K", "R", "D", "I"} <= set("".join(r[7] for r in want))


def test_op12_equals_its_sql(spark, tmp_path):
    rows = [r for r in table(8) if r[0] is None or r[0] < 200]
    frame(spark, rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    base = duckdb.connect()
    base.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    told = base.execute(f"select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from ({queries.OP12_SQL})").fetchall()
    assert sorted(told, key=repr) == sorted((tuple(r) for r in queries.op12_conversations(spark, str(tmp_path)).collect()), key=repr) == expected(rows)


def test_no_rows_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.judged(frame(spark, [(dropped, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert conversations.judged(frame(spark, [], SCHEMA)).collect() == []


def test_sections_give_what_the_whole_gives():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), f"{i}.", rng.choice([1, 1, 1, 2]), rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(1, 14))]
        ((_, (cost, audit)),) = conversations.searched(rows, 0, conversations.ACCEPTING).items()
        at = rng.randint(0, len(rows))
        both = [(c + d, a + b) for m, (c, a) in conversations.searched(rows[:at], 0, None).items() for e, (d, b) in conversations.searched(rows[at:], m, None).items() if e in conversations.ACCEPTING]
        assert min(both) == (cost, audit)
