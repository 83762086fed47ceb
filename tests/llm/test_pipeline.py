"""The pipeline, stage by stage, on awkward rows and columns with clashing names."""

import os

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quoin.llm.common import shared_dir
from quoin.llm.queries import vocabulary_path
from tests.llm.helpers import corpus, frame, prose
from tests.llm.test_documents import plain_hits
from tests.llm.test_jaccard import brute
from tests.llm.test_models import base


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    quoted = prose(50, 30)
    rows = corpus() + [(200 + i, prose(300 + i, 80) + " mail me@here.org", "en", "s", 3) for i in range(40)] + [(300 + i, " ".join(w + "***" for w in prose(600 + i, 80).split()), "en", "s", 3) for i in range(40)]
    rows += [(400, prose(700, 30) + " " + quoted, None, None, None)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    frame(spark, [(200 + i, 1, 0) for i in range(40)] + [(300 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame(spark, [(0, quoted)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run(spark, folder):
    shared = shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, folder).collect()
    assert len([p for p in set(os.listdir(shared)) - there if "-" in p and p.partition("-")[0].isalpha()]) <= 1
    ids = {r.doc_id for r in out}
    assert not ids & set(range(300, 340)) and 400 not in ids and len(ids & set(range(200, 240))) >= 38
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)


def redacted(text):
    """The text with its base forms named, the first of overlapping ones."""
    at, out = 0, ""
    for start, end, kind in sorted((a, -b, k) for k, a, b in base(text)):
        if start >= at:
            out, at = out + text[at:start] + f"<{kind.upper()}>", -end
        else:
            at = max(at, -end)
    return out + text[at:]


def test_stages_against_plain_versions(spark, folder):
    """Each stage on what the one before it kept: near copies, benchmark passages, base forms and ids by brute force."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    good = corpus_pipeline.good_quality(spark, docs, folder)
    ids = {i for i, _ in rows(good)}
    assert len(ids & set(range(200, 240))) >= 38 and not ids & set(range(300, 340))

    single = corpus_pipeline.one_of_near_copies(spark, good, folder)
    own = rows(good)
    assert rows(single) == [own[k] for k in sorted(brute([t for _, t in own]))]

    # the quoting document may have gone for its quality: here it comes back
    single = single.unionByName(docs.filter("doc_id = 400")).distinct()
    clean = corpus_pipeline.uncontaminated(spark, single, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    own = rows(single)
    hit = [x[-1] for x in plain_hits(own, items)]
    assert any(hit) and rows(clean) == [r for r, h in zip(own, hit, strict=True) if not h]

    private = corpus_pipeline.without_personal_data(spark, clean, folder)
    assert rows(private) == [(i, None if t is None else redacted(t)) for i, t in rows(clean)]

    library = Tokenizer.from_file(vocabulary_path())
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.token_ids(spark, private, folder).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows(private)}
    assert got == {i: (len(x), x) for i, x in want.items()}


def test_stages_keep_columns_and_survive_clashes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = {c: docs["source"] for c in ("row", "base", "seen", "spans", "score", "held_out", "predicted", "ids", "n_words", "found", "fp", "contaminated", "_digit", "kind", "name")}
    wide = docs.withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and out.schema.simpleString() == wide.schema.simpleString()
        assert out.count() <= wide.count()
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == wide.count()


def test_stages_on_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_personal_data_goes_and_the_rest_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.without_personal_data(spark, docs, folder)
    assert out.count() == docs.count()
    assert out.filter("text like '%me@here.org%'").count() == 0 and out.filter("text like '% mail <EMAIL>'").count() == 40
    assert out.filter("n_chars <> char_length(text)").count() == 0
