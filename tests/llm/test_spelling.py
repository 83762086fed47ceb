"""Spelling variants against all edits, and the query against its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quoin.llm import queries, spelling
from tests.llm.helpers import LOWER, corpus, frame, prose


def edits(word, letters):
    deleted = {word[:i] + word[i + 1 :] for i in range(len(word))}
    replaced = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    inserted = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return (deleted | replaced | inserted) - {word}


def test_automata_accept_what_one_edit_makes():
    rng = random.Random(1)
    for _ in range(60):
        letters = "abé"[: rng.randint(1, 3)]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(rng.randint(1, 150))}
        trie = spelling.trie_of(sorted(words.items()))
        for word in [*words, "ab", "b" * 10, "aé"]:
            assert spelling.accepted(word, trie) == {w: words[w] for w in edits(word, "abé") & set(words)}


def expected(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = set("".join(n))
    near = {w: edits(w, letters) & set(n) for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items())


def spelt():
    rng = random.Random(4)
    text = prose(8, 4000).split()
    for _ in range(900):
        k = rng.randrange(len(text))
        at = rng.randrange(len(text[k]))
        text[k] = text[k][:at] + rng.choice(["", "x", "é"]) + text[k][at + rng.randrange(2) :]
    chain = ["colour"] * 40 + ["colou"] * 20 + ["colo-u"] * 3 + ["olou"] * 9 + ["solou"] * 4 + ["x" * 3000] * 4 + ["x" * 3001] * 9
    return [*[(r[0], r[1]) for r in corpus()], *[(100 + i, " ".join(text[i::40])) for i in range(40)], (None, " ".join(chain)), (None, " ".join(chain))]


@pytest.mark.parametrize("most_words", [300, 100_000])
def test_variants_are_those_of_all_edits(spark, most_words):
    rows = spelt()
    docs = frame(spark, [(*r, "kept out") for r in rows], "doc_id long, text string, word string")
    got = spelling.variants(docs, most_words=most_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == expected(rows)
    assert any(r[1] != r[2] and r[1] for r in expected(rows))


def test_op11_equals_its_sql(spark, tmp_path):
    rows = spelt()
    frame(spark, rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = base.execute(f"select word, form, root, n, n_near, form_n from ({queries.OP11_SQL})").fetchall()
    assert sorted(told) == sorted(tuple(r) for r in queries.op11_spelling(spark, str(tmp_path)).collect()) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "one two 12 ×")]])
def test_no_words(spark, rows):
    assert spelling.variants(frame(spark, rows, "doc_id long, text string")).collect() == []
