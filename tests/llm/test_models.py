"""Personal data, languages, quality and top-k."""

import re
import zlib

import numpy as np
import pytest

from quoin.llm import language, pii, quality, queries, topk
from tests.llm.helpers import corpus, frame, prose, sha

FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x // 10 + x % 10 for i, c in enumerate(reversed(d)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, form in FORMS for m in re.finditer(form, text or "") if holds(k, m[0])]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


AWKWARD = [
    "a@b.co", "a@b.co.c@d.org x", "foo@@bar.com a.b@c", "x@y.z.@q.r-s.t", "é a@b.c😀d@e.f", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 1..2.3.4", "9" * 5000, "1." * 3000 + "1", "4111-1111 11111111 x4111111111111111y 41111111111111112",
    "4111  1111 1111 1111", "+1 (743) 555-3824, +12 3, +1234567890123456 +49 170 1234567-", "+1" + " " * 4000, "a" * 20_000 + "@", "+" * 500 + "1 2345678", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "5555555555554444 4012888888881881,378282246310005", "a@b.c" * 300, "%@-.-", "12345678901234567890 4242424242424242 4",
]


def test_op6(spark, tmp_path):
    rows = corpus() + [(1000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = base(t)
        assert got[i].base_sha256 == sha(listed(want)), t
        assert [got[i][f"n_{k}"] for k, _ in FORMS] == [sum(x[0] == k for x in want) for k, _ in FORMS]
        assert set(listed(want).split(",")) <= set(got[i].spans.split(","))


def test_contexts_find_what_has_no_form(spark):
    rows = [(i, f"{prose(i, 8)} reach me +1 (743) 555-{1000 + i} soon {prose(i + 99, 5)}", None, None, None) for i in range(30)]
    rows += [(50, "reach me (743) 555-9999 too", None, None, None), (51, "version 4.0 of 12 things in 2021", None, None, None), (52, "or me 743 555 9998.", None, None, None), (53, "me " + "1 2 3 4 5 6 " * 9, None, None, None)]
    got = {r.doc_id: r.s for r in pii.found(frame(spark, rows)).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert got[50] == "phone:9:23" and got[51] == "" and got[52] == "phone:6:18" and got[53] == ""
    assert all(got[i].count("phone") == 1 for i in range(30))


def test_what_is_found_induces_patterns(spark):
    """Contexts of the second generation: no seed stands before 'wanted', only instances that 'me' has told."""
    rows = [(i, f"me +1 743 555 {1000 + i} soon", None, None, None) for i in range(60)]
    rows += [(100 + i, f"me 743 556 {1000 + i} wanted", None, None, None) for i in range(12)]
    rows += [(200, "dial 743 557 1000 wanted", None, None, None), (201, "sum 743 557 1001 paid", None, None, None)]
    got = {r.doc_id: r.s for r in pii.found(frame(spark, rows)).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert all(got[100 + i] == "phone:3:15" for i in range(12)) and got[200] == "phone:5:17" and got[201] == ""


def test_contexts_are_whole_words(spark):
    """Two contexts that differ only after very many letters are two."""
    long = "w" * 300
    rows = [(i, f"{long}x +1 743 555 {1000 + i} .", None, None, None) for i in range(20)]
    rows += [(100, f"{long}x\t743 556 1000", None, None, None), (101, f"{long}y 743 556 1001", None, None, None)]
    got = {r.doc_id: r.s for r in pii.found(frame(spark, rows)).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert got[100] == "phone:302:314" and got[101] == ""


def test_recall_and_precision_of_what_contexts_tell(spark):
    """Identifiers without a base form in contexts of seeds, and numbers in contexts of their own, each told or not."""
    rng = np.random.default_rng(6)
    mine, others = ["mail", "ring", "ip", "card"], ["worth", "page", "year", "code", "sum"]
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    seed = {"mail": lambda: f"{prose(int(rng.integers(1e9)), 1)}@here.org", "ring": lambda: f"+{rng.integers(1, 9)}{digits(9)}", "ip": lambda: "10.0.{}.{}".format(*rng.integers(0, 256, 2)), "card": lambda: next(c for c in (digits(16) for _ in range(999)) if luhn(c))}
    bare = {"mail": lambda: f"{digits(4)}@local", "ring": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "ip": lambda: "10.0.{}.{}".format(*rng.integers(300, 1000, 2)), "card": lambda: f"4{digits(11)}"}
    rows, planted = [], {}
    for i in range(1200):
        before, after = prose(3 * i, 6), prose(3 * i + 1, 6)
        if rng.random() < 0.5:
            kind = mine[i % 4]
            without = rng.random() < 0.15
            own = bare[kind]() if without else seed[kind]()
            assert bool(base(own)) != without
        else:
            kind, without, own = others[i % 5], False, digits(int(rng.integers(4, 9)))
        if without:
            planted[i] = (len(before) + len(kind) + 2, len(before) + len(kind) + 2 + len(own))
        rows.append((i, f"{before} {kind} {own} {after}", None, None, None))
    found = pii.found(frame(spark, rows)).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    added = {(r.doc_id, *map(int, x.split(":")[1:])) for r in found for x in r.s.split(",") if x and x not in r.b.split(",")}
    right = {(i, a, b) for i, (a, b) in planted.items()}
    recall, precision = len(added & right) / len(right), len(added & right) / max(1, len(added))
    print(f"added spans: recall {recall:.3f}, precision {precision:.3f} of {len(right)}")
    assert recall >= 0.9 and precision >= 0.95


def test_redaction(spark):
    rows = [(1, "mail a@b.co, call +1 (743) 555-3824 😀 now", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, "é 1.2.3.4", None, None, None)]
    got = {r.doc_id: r.t for r in pii.found(frame(spark, rows)).select("doc_id", pii.redacted().alias("t")).collect()}
    assert got == {1: "mail <EMAIL>, call <PHONE> 😀 now", 2: None, 3: "", 4: "é <IP>"}


def tongues(n):
    words = {"xx": "ka lo mi ne ru ta".split(), "yy": "brz gšt čvr plk dnn".split(), "zz": "the and ing ou".split()}
    rng = np.random.default_rng(4)
    return [(i, " ".join("".join(rng.choice(words[l], 3)) for _ in range(20)), l, None, None) for i in range(n) for l in [("xx", "yy", "zz")[i % 3]]]


def test_op8(spark, tmp_path):
    rows = [*tongues(300), (900, None, "xx", None, None), (901, "12 !!", "xx", None, None), (902, "", None, None, None), (903, "KALOMI " * 9000, None, None, None), (903, "日本語", None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) == 1
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 903} == {"xx", min(lang_ for lang_ in "xx yy zz".split())}


def plain_phrases(text, samples):
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and any(text[i : j + 1] in s for s in samples):
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


@pytest.mark.parametrize("segment,lot", [(256, 1 << 20), (7, 1 << 20), (3, 50)])
def test_phrases_are_those_of_greedy_parsing(monkeypatch, segment, lot):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "LOT", lot)
    samples = {"a": ["banana band", "and an"], "b": ["nab dab"]}
    model = language.Model(samples)
    text = "banana nab dand" * 30
    symbols = language.symbols(text, language.letter_table(model.letters), model.other)
    got = model.phrases([symbols, symbols[:1]])
    for k, lang in enumerate(model.languages):
        assert got[k, 0] == plain_phrases(text, samples[lang]) and got[k, 1] == 1


@pytest.mark.parametrize("segment", [1, 5, 256])
def test_whole_texts_are_parsed_as_one(monkeypatch, segment):
    """Phrases longer than several segments, unknown letters, many languages, texts of all lengths."""
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "SIDE", 2)
    rng = np.random.default_rng(8)
    word = lambda n, letters="abcd": "".join(rng.choice(list(letters), n))
    samples = {f"l{k}": [word(400), word(60, "ab")] for k in range(5)}
    model = language.Model(samples)
    texts = [samples["l0"][0], samples["l3"][0][:390] + samples["l1"][0][7:], word(700, "abcde"), word(1), "a" * 300, word(513, "ab") + samples["l2"][0]]
    table = language.letter_table(model.letters)
    got = model.phrases([language.symbols(t, table) for t in texts])
    assert got.tolist() == [[plain_phrases(t, samples[lang]) for t in texts] for lang in model.languages]


def test_op8_without_labels(spark, tmp_path):
    frame(spark, [(1, "abc", None, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.lang_pred for r in queries.op8_language(spark, str(tmp_path)).collect()] == ["und"]


def test_op10(spark, tmp_path):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "***" for w in prose(i, 60).split()), None, None, None) for i in range(360)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(360)] + [(3, 0, 0), (None, 1, 0), (7, None, 0)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "long " * 50_000, None, None, None), (3, rows[3][1], None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 360]
    assert held and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95


def test_op10_without_labels(spark, tmp_path):
    frame(spark, [(1, "abc", None, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.score for r in queries.op10_quality(spark, str(tmp_path)).collect()] == [0.5]


def test_linear_time_identity():
    m = quality.Machine()
    at, x = np.array([0, 40, 77]), np.array([0.5, 1.0, -2.0], np.float32)
    v = m.vectors[at].astype(float)
    pairs = sum(x[i] * x[j] * (v[i] @ v[j]) for i in range(3) for j in range(i))
    assert abs(m.raw(at, x)[0] - pairs) < 1e-5


def plain_top(rows, k=20):
    out = []
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for row, (i, v) in enumerate(usable):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(usable) if other != row)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block,batch", [(16_384, 8192), (50, 3)])
def test_op9(spark, tmp_path, monkeypatch, block, batch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BATCH", batch)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6).round(1)]) for i in range(400)]
    rows += [(400, None), (420, [1.0, None, 0.5]), (440, [float("nan")] * 6), (441, [float("inf")] * 6), (None, [0.1] * 6), (460, []), (461, [0.5, -0.5]), (480, [-9.0] * 6), (500, [0.0] * 6)]
    frame(spark, rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op9_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == plain_top(rows)


def test_op9_by_row_as_its_sql(spark, tmp_path):
    """Rows that share an id are candidates of one another, and queries of their own."""
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 4)]) for i in (0, 0, 1, 20, 20, 20, 33)] + [(40, [0.25] * 4), (40, [0.25] * 4), (41, [0.25] * 4)]
    frame(spark, rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op9_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    c = duckdb.connect()
    c.sql(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == plain_top(rows) == sorted(c.sql(f"select query_id, rank, vec_id, score from ({queries.OP9_SQL})").fetchall())
    assert len(got) == 7 * 9


def test_op9_small_tables(spark, tmp_path):
    frame(spark, [], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert queries.op9_topk(spark, f"{tmp_path}/a").count() == 0
    frame(spark, [(0, [0.5]), (1, [0.5]), (2, [0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert sorted(map(tuple, queries.op9_topk(spark, f"{tmp_path}/b").select("query_id", "rank", "vec_id", "score").collect())) == [(0, 1, 1, 1024), (0, 2, 2, 1024)]


@pytest.mark.parametrize("name", ["op6_pii", "op8_language"])
def test_empty_tables(spark, tmp_path, name):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0
