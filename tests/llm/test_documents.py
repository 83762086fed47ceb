"""Operators over documents against brute force, on small tables with awkward rows."""

import random
import zlib
from contextlib import contextmanager

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quoin.llm import common, components, decontamination, queries, sharding, simhash, suffixes
from tests.llm.helpers import LOWER, ascii_words, bench_words, corpus, frame, prose, sha


def table(spark, path, rows, name="documents", **schema):
    frame(spark, rows, **schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def unique_ids(rows):
    return [(k, *r[1:]) for k, r in enumerate(rows)]


# sharding


def test_op2(spark, tmp_path):
    rows = unique_ids(corpus())
    got = queries.op2_sharding(spark, table(spark, tmp_path, rows)).collect()
    text = {i: t for i, t, *_ in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    of_text, slots = {}, {}
    for r in got:
        of_text.setdefault(text[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in of_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= r.shard < 40 for r in got)


def test_shards_are_balanced(spark):
    rows = [(i, prose(i, 5 + i % 90), None, None, None) for i in range(800)]
    got = sharding.shard(frame(spark, rows), 7).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert len(loads) == 7 and max(loads) - min(loads) <= 16


def test_differencing_matches_its_loads():
    rng = random.Random(5)
    loads = [rng.randint(1, 1000) for _ in range(300)]
    bins, sums = sharding.differenced(loads, 6)
    told = [0] * 6
    for x, b in zip(loads, bins, strict=True):
        told[b[0]] += x
    assert sorted(told) == sorted(sums) and max(told) - min(told) <= 2
    vectors = [tuple(rng.randint(0, 50) for _ in range(6)) for _ in range(40)]
    bins, sums = sharding.differenced(vectors, 6)
    told = [0] * 6
    for v, b in zip(vectors, bins, strict=True):
        assert sorted(b) == list(range(6))
        for x, to in zip(v, b, strict=True):
            told[to] += x
    assert sorted(told) == sorted(sums)


def test_many_blocks_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 4)
    sums = spark.createDataFrame([(b, [b % 7, 3, b % 5]) for b in range(40)], "block long, loads array<long>")
    to = sharding._merged(spark, sums, 3).collect()
    assert sorted((r.block, r.bin) for r in to) == [(b, k) for b in range(40) for k in range(3)]
    assert all(sorted(r.shard for r in to if r.block == b) == [0, 1, 2] for b in range(40))


# near copies


def plain_fingerprint(text, size=3):
    w = ascii_words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, ids, distance=3):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(fps))]


def near_copies(n):
    rows = corpus()
    base = prose(8, 400).split(" ")
    for k in range(n):
        own = list(base)
        own[k % 390] = f"w{k}"
        rows.append((100 + k, " ".join(own), "en", None, 1))
    return rows


def test_op3(spark, tmp_path):
    rows = [*near_copies(60), (None, prose(2, 200), None, None, None)]
    got = queries.op3_simhash(spark, table(spark, tmp_path, rows)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted((str(r[0]), f"{f:016x}", c) for r, f, c in zip(rows, fps, linked(fps, [r[0] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len(set(fps)) > len({c for *_, c in want})  # some are linked that aren't equal


def clustered(n, seed=4):
    """Fingerprints in clouds around few centres, so that many share blocks."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(n)}
    return sorted(out | {0, (1 << 64) - 1, 7})


def test_links_divide_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PLACE", 8)
    fps = clustered(70)
    edges = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")).collect()
    assert all((e.a ^ e.b).bit_count() <= 64 for e in edges)
    parent = {simhash.signed(f): simhash.signed(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[root(e.a)] = root(e.b)
    want = linked(fps, list(range(len(fps))))
    got = {}
    for f, w in zip(fps, want, strict=True):
        got.setdefault(root(simhash.signed(f)), set()).add(w)
    assert all(len(s) == 1 for s in got.values()) and len(got) == len(set(want))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_in_place(spark, how):
    left = [(k % 5 if k % 3 else 7, k) for k in range(300)] + [(None, 900), (99, 901)] + [(1000 + k, k) for k in range(700)]
    right = [(k, f"name {k}") for k in [*range(8), *range(1000, 1400)]]
    names = dict(right)
    rows = spark.createDataFrame(left, "k long, v long")
    got = sorted(((r.k, r.v, r.n) for r in common.looked_up(rows, spark.createDataFrame(right, "k long, n string"), ["k"], how).collect()), key=str)
    assert got == sorted(((k, v, names.get(k)) for k, v in left if how == "left" or k in names), key=str)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 90)] + [(5, 5), (2000, 1999)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    want = {i: 0 for i in range(1, 201)} | {1000 + k: 1000 for k in range(1, 90)} | {2000: 1999}
    assert got == want


def test_representatives_keep_one_row_each(spark):
    rows = near_copies(20)
    kept = simhash.representatives(frame(spark, rows)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    assert len(kept) == len(set(linked(fps, list(range(len(rows))))))
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


# suffixes


def brute_dedup(rows, length=100):
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1])), sha(kept)))
    return out


@pytest.mark.parametrize("limit,crowd", [(1 << 19, 4096), (300, 6)])
def test_op4(spark, tmp_path, monkeypatch, limit, crowd):
    monkeypatch.setattr(suffixes, "SORTED", limit)
    monkeypatch.setattr(suffixes, "CROWD", crowd)  # small: crowded anchors are settled in parts
    passage = prose(77, 60)
    rows = unique_ids(near_copies(12))
    rows += [(500 + k, prose(900 + k, 40) + " " + passage + " " + prose(800 + k, 30), None, None, None) for k in range(25)]
    rows += [(600, "ß" * 300, None, None, None), (601, "ab" * 500, None, None, None), (602, "x" * 99, None, None, None), (603, "x" * 100, None, None, None)]
    got = sorted(map(tuple, queries.op4_suffixes(spark, table(spark, tmp_path, rows)).collect()))
    assert got == brute_dedup(rows)


def test_op4_rows_that_share_an_id(spark):
    text = prose(1, 100)
    got = suffixes.deduplicated(frame(spark, [(3, text, None, None, None), (3, text, None, None, None), (None, text, None, None, None)])).collect()
    assert sorted((str(r.doc_id), len(r.kept)) for r in got) == [("3", 0), ("3", 0), ("None", len(text))]


def test_op4_compares_bytes(spark):
    """Two texts that a linear sum of their bytes can't tell apart keep all."""
    a = "odgobdvnbdrrxuhxtfnsqgdxisvrrpctzwldupdoqfjfgjfjtnvmedypczdcezqzwzugknjbvlcmdgtetvpcossqqaxesxghfubn"
    b = "odgobdvnbdrrxuhxtfnsqgdxisvrrpctelnrosqroejyjhhmkjqnexwrvkqicvlyxwppwmclpbtnyvyougffjxwngsljxnegdkly"
    rows = [(1, a, None, None, None), (2, b, None, None, None), (3, "q" + b, None, None, None)]
    assert {r.doc_id: len(r.kept) for r in suffixes.deduplicated(frame(spark, rows)).collect()} == {1: 100, 2: 100, 3: 1}


def test_op4_leaves_nothing_behind(spark):
    suffixes.deduplicated(frame(spark, near_copies(3))).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_pieces_of_long_texts_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "BUFFER", 1000)
    for n in (0, 99, 100, 999, 1000, 1099, 1100, 5432):
        text = np.random.default_rng(n).integers(97, 123, n, np.uint8).tobytes()
        at = [start + k for start, piece in suffixes._pieces(text) for k in range(len(piece) - suffixes.LENGTH + 1)]
        assert at == list(range(max(0, n - suffixes.LENGTH + 1)))
        assert all(text[start:].startswith(piece) for start, piece in suffixes._pieces(text))


def test_classes_of_windows():
    rng = np.random.default_rng(4)
    anchors = [rng.integers(97, 123, suffixes.ANCHOR, np.uint8).tobytes() for _ in range(3)]
    rows = []
    for g in sorted(int(x) for x in rng.integers(0, 3, 60)):
        at, more = int(rng.integers(0, 69)), int(rng.integers(0, 30))
        more = min(more, at)
        before, after = bytes(rng.choice(list(b"ab"), at, p=[0.97, 0.03]).tolist()), bytes(rng.choice(list(b"ab"), 68 - at + more, p=[0.97, 0.03]).tolist())
        rows.append((g, before + anchors[g] + after, at, more))
    group, spans, at, more = (list(x) for x in zip(*rows, strict=True))
    got = {(int(x), d): bool(e) for d, here, earliest in suffixes.classes(np.array(group), spans, np.array(at), np.array(more)) for x, e in zip(here, earliest, strict=True)}
    want, known = {}, set()
    for k, (g, s, a, m) in enumerate(rows):
        for o in range(m + 1):
            w = (g, a - o, s[o : o + suffixes.LENGTH])
            want[k, a - o] = w not in known
            known.add(w)
    assert got == want


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (900, 4)).astype(np.uint64)
    classes = suffixes.multikey_quicksort(words, np.arange(900))
    keys = [tuple(words[c[0]]) for c in classes]
    assert keys == sorted(set(map(tuple, words))) and all(len({tuple(words[i]) for i in c}) == 1 for c in classes)


# decontamination


def plain_hits(rows, items, size=13):
    out = []
    for i, t, *_ in rows:
        w, hit, found = bench_words(t), set(), set()
        for item, it in items:
            b = bench_words(it)
            k = min(size, len(b))
            if not k:
                continue
            wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit.update(range(j, j + k))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [16 << 20, 600])
def test_op7(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "PASS_BYTES", limit)
    quoted = prose(50, 30)
    items = [(0, quoted), (1, "Not, there; at ALL of these words are found in any text but one"), (2, "one two"), (3, None), (4, ""), (5, "...!"), (10, quoted + " and more"), (None, "été à"), (2, "one two"), (7, "the")]
    rows = unique_ids(corpus()) + [(50, prose(51, 100) + ". " + quoted.replace(" ", "\n--") + "!", None, None, None), (51, quoted.upper(), None, None, None), (52, " ".join(quoted.split()[:12]), None, None, None)]
    path = table(spark, tmp_path, rows)
    table(spark, tmp_path, items, "benchmark", schema="item_id long, text string")
    assert sorted(map(tuple, queries.op7_decontamination(spark, path).collect())) == sorted(plain_hits(rows, items))


def test_passes_are_held_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_BYTES", 400)
    items = [(k, prose(40 + k, 14)) for k in range(20)]
    docs = [(k, f"{prose(60 + k, 20)} {items[k % 20][1]} {items[(k + 7) % 20][1]}", None, None, None) for k in range(30)]
    now, most, sizes, real = [0], [0], [], decontamination.sent

    @contextmanager
    def counted(spark, own):
        now[0] += 1
        most[0] = max(most[0], now[0])
        sizes.append(sum(len(t.encode()) for _, t in own))
        with real(spark, own) as shared:
            yield shared
        now[0] -= 1

    monkeypatch.setattr(decontamination, "sent", counted)
    wide = frame(spark, docs).withColumn("_row", F.lit("mine"))
    got = decontamination.judged(wide, frame(spark, items, "item_id long, text string"))
    assert most == [1] and len(sizes) > 3 and sum(sizes) == sum(len(t.encode()) for _, t in items)
    assert max(sizes) < 4 * 400  # about half of the limit each, dealt by hash
    assert got.columns[: len(wide.columns)] == wide.columns
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == [(i, w, h, n) for i, w, h, n, *_ in plain_hits(docs, items)]


def test_op7_without_items(spark, tmp_path):
    path = table(spark, tmp_path, unique_ids(corpus()))
    table(spark, tmp_path, [], "benchmark", schema="item_id long, text string")
    assert {r.n_hit for r in queries.op7_decontamination(spark, path).collect()} == {0}


def test_lower_casing_leaves_other_letters():
    assert b" ".join(decontamination.words("ÀÉ Az_9")).decode() == "ÀÉ az 9" == " ".join(bench_words("ÀÉ Az_9".translate(LOWER)))


@pytest.mark.parametrize("name", ["op2_sharding", "op3_simhash", "op4_suffixes"])
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, table(spark, tmp_path, [])).count() == 0
