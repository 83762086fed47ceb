"""Licence templates against a backtracking matcher, and the query against its SQL."""

import random

import duckdb
import pytest

from quoin.llm import licenses, queries
from tests.llm.helpers import bench_words, corpus, frame, prose

SCHEMA = "doc_id long, text string, labels string"


def ends(items, words, at):
    """Where the items may end if they begin at a word."""
    if not items:
        return {at}
    item, rest = items[0], items[1:]
    if isinstance(item, bytes):
        return ends(rest, words, at + 1) if words[at : at + 1] == [item.decode()] else set()
    if isinstance(item, tuple):
        return set().union(*(ends(rest, words, at + k) for k in range(item[0], item[1] + 1) if at + k <= len(words)))
    return ends(rest, words, at) | {e for mid in ends(item, words, at) for e in ends(rest, words, mid)}


def expected(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    words = bench_words(text)
    places = [(label, at) for label, phrase in phrases for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
    own = sorted({(e - 1, label) for label, markup in templates for at in range(len(words)) for e in ends(licenses.parsed(markup), words, at)})
    starts, base = [at for _, at in places], sorted({label for label, _ in places})
    labels = sorted({*base, *(label for _, label in own)})
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1.0 if own else 0.5 if base else 0.0), [(label, last) for last, label in own]


def filled(items, rng):
    out = []
    for item in items:
        if isinstance(item, bytes):
            out.append(item.decode())
        elif isinstance(item, tuple):
            out += [rng.choice(["any", "under", "the", "é"]) for _ in range(rng.randint(*item))]
        elif rng.random() < 0.5:
            out += filled(item, rng)
    return out


def texts():
    rng = random.Random(6)
    out = [t for _, t, *_ in corpus()] + ["MIT License", "mit\x00license, (MIT-LICENSE)", "Licensed under CC BY-NC 4.0.", "gnu general public licence", "under the mit  license" * 3, "cc by cc by"]
    for label, markup in licenses.TEMPLATES:
        for _ in range(3):
            words = filled(licenses.parsed(markup), rng)
            shown = "".join(w.upper() + rng.choice([" ", ", ", "\n", "-"]) if rng.random() < 0.2 else w + " " for w in words)
            out.append(prose(len(out), 20) + " " + shown + prose(len(out), 9))
            at = rng.randrange(len(words))
            out.append(" ".join([*words[:at], "changed", *words[at + 1 :]]))
    return out


def test_markup_of_a_few_words_accepts_what_backtracking_accepts():
    rng = random.Random(3)

    def made(depth):
        return "".join(rng.choice(["a ", "b ", "{{0-1}} ", "{{1-3}} ", *(["[[%s]] " % made(depth - 1)] if depth else [])]) for _ in range(rng.randint(1, 4)))

    for _ in range(150):
        templates = [(f"t{k}", "a " + made(2)) for k in range(3)]
        automaton = licenses.Automaton([*((label, licenses.parsed(m), False) for label, m in templates), ("p", licenses.parsed("b a"), True)])
        for _ in range(4):
            text = " ".join(rng.choice("aabc") for _ in range(rng.randint(0, 12)))
            want, own = expected(text, templates, (("p", "b a"),))
            got = licenses.judged(automaton, text)
            assert (got[:7], sorted({(x["label"], x["last"]) for x in got[7]})) == (want, sorted(own))


def test_pieces_and_full_tables_change_nothing(monkeypatch):
    compiled = [*((label, licenses.parsed(m), False) for label, m in licenses.TEMPLATES), *((label, licenses.parsed(p), True) for label, p in licenses.PHRASES)]
    rows = [t for t in texts() if t and len(t) < 3000]
    whole = [licenses.Automaton(compiled).read(t) for t in rows]
    assert whole == [licenses.Automaton(compiled).read(t, size) for t, size in zip(rows, [1, 7, 100] * len(rows), strict=False)]
    monkeypatch.setattr(licenses, "SETS", 3)
    automaton = licenses.Automaton(compiled)
    assert whole == [automaton.read(t) for t in rows]


def test_scans(spark):
    rows = [(i % 90, t, "theirs") for i, t in enumerate(texts())]
    got = licenses.scanned(frame(spark, rows, SCHEMA)).collect()
    assert got[0].__fields__ == ["doc_id", "text", *licenses.MADE.names]
    shown = lambda r: (r.doc_id, r.text or "", tuple(r)[2:9], [(x.label, x.last) for x in r.accepted])
    assert sorted(map(shown, got), key=repr) == sorted(((i, t or "", *expected(t)) for i, t, _ in rows), key=repr)
    assert {label for r in got for label in r.labels.split(",") if label} >= {label for label, _ in licenses.TEMPLATES}


def test_op13_equals_its_sql(spark, tmp_path):
    frame(spark, [(i, t, None) for i, t in enumerate(texts())], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = base.execute(f"select doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from ({queries.OP13_SQL})").fetchall()
    assert sorted(told) == sorted(tuple(r) for r in queries.op13_licenses(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("markup", ["a [[b", "a b]]", "[[a]] {{0-2}}"])
def test_bad_markup_is_refused(markup):
    with pytest.raises(ValueError):
        licenses.Automaton([("x", licenses.parsed(markup), False)])


def test_empty_table(spark):
    assert licenses.scanned(frame(spark, [], SCHEMA)).collect() == []
