"""BPE and the token store against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoin.llm import bpe, queries, token_store
from tests.llm.helpers import corpus, frame, sha

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("memo", [lambda: bpe.coder(PATH)[1], lambda: token_store.library_memo(PATH)[1]])
def test_memo_equals_library(library, memo):
    memo = memo()
    alphabet = st.sampled_from(list("ab é\n\t  '.19ßñÉ日本\x1c\x85😀sre_²½ªⅣ") + ["<|endoftext|>", "   ", "'ll"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(alphabet, max_size=14).map("".join))
    def same(text):
        assert np.frombuffer(memo.ids([text])[0], "<u2").tolist() == ids_of(library, text)

    same()


def test_pieces_that_are_new_are_coded_together(library, monkeypatch):
    """Digits, signs and letters beyond ASCII as well: the library's model isn't asked for each of their pre-tokens."""
    memo, asked = token_store.library_memo(PATH)[1], []
    monkeypatch.setattr(memo, "encode", lambda words, own=memo.encode: asked.extend(words) or own(words))
    texts = ["".join(f" x{i}{j},y-{j} ñ{i}º.{j}  don't it's¿{j} \u00ff{i}ÿ{j}" for j in range(50)) for i in range(20)]
    assert [np.frombuffer(b, "<u2").tolist() for b in memo.ids(texts)] == [ids_of(library, t) for t in texts]
    assert len(asked) <= len(texts)


def test_pairs_of_tokens(library):
    vocabulary, memo = bpe.coder(PATH)
    rng = np.random.default_rng(3)
    tokens = [b.decode() for b in vocabulary.token_bytes if b and b.decode("utf-8", "ignore").encode() == b]
    texts = ["".join(rng.choice(tokens, 3)) for _ in range(2000)]
    assert [np.frombuffer(b, "<u2").tolist() for b in memo.ids(texts)] == [ids_of(library, t) for t in texts]


def test_encode_and_decode(spark, library):
    rows = corpus()
    coded = bpe.encode(frame(spark, rows), PATH).collect()
    assert {"doc_id", "lang", "source", "n_chars", "ids"} == set(coded[0].asDict())
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in coded) == sorted(ids_of(library, t) for _, t, *_ in rows)
    back = bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in rows)


def test_op1(spark, library, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, len(x := ids_of(library, t)), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False))) for i, t, *_ in rows)
    assert sorted(map(tuple, queries.op1_bpe(spark, str(tmp_path)).collect())) == want


def test_bytes_that_are_no_text(spark):
    broken = spark.createDataFrame([(bytearray(np.array([0x1234, 127, 128, 255], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r.text for r in bpe.decode(broken, PATH).collect()][1] == ""


def test_op5(spark, library, tmp_path):
    rows = [r for r in corpus() if r[0] not in (5, 7)] + [(90, "again " * 9000, None, None, None), (91, "again " * 9000, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for i, t, *_ in sorted(rows):
        ids = [*ids_of(library, t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op5_token_store(spark, str(tmp_path)).collect())) == want


def test_store_holds_chunks_once_and_gives_ids_back(spark, library, tmp_path):
    text = "again and more " * 3000
    store = f"file://{tmp_path}/store"
    token_store.write(frame(spark, [(i, text, None, None, None) for i in range(6)]), store, PATH, 2)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("name").distinct().count()
    ids = [*ids_of(library, text), 2]
    assert chunks.agg({"n": "sum"}).head()[0] <= len(ids)
    assert {np.frombuffer(r.ids, "<u2").tolist() == ids for r in token_store.read_ids(spark, store, "<u2").collect()} == {True}


def test_damage_is_found(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    token_store.write(frame(spark, corpus()), store, PATH, 2)
    chunks = spark.read.parquet(f"{store}/chunks").toPandas()
    chunks.loc[0, "payload"] = bytes(len(chunks.loc[0, "payload"]))
    spark.createDataFrame(chunks, "name binary, n int, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/other")
    with pytest.raises(Exception, match="damaged"):
        token_store.chunk_sums(spark.read.parquet(f"{tmp_path}/other"), "<u2").collect()


@pytest.mark.parametrize("harm,says", [("lost", "manifests"), ("doubled", "manifests"), ("swapped", "manifests"), ("part", "manifests"), ("manifest", "root")])
def test_damaged_recipes_are_found(spark, tmp_path, harm, says):
    store, other = f"file://{tmp_path}/store", f"file://{tmp_path}/other"
    token_store.write(frame(spark, corpus()), store, PATH, 2)
    for name in ("chunks", "recipes", "manifests", "root"):
        rows = spark.read.parquet(f"{store}/{name}")
        if name == "recipes":
            some = rows.filter("doc_id = 5").limit(1)
            rows = {"lost": rows.filter("doc_id <> 8"), "doubled": rows.unionAll(some), "swapped": rows.withColumn("doc_id", F.expr("if(doc_id = 8, 9, if(doc_id = 9, 8, doc_id))")), "part": rows.filter("part > 0")}.get(harm, rows)
        if name == "manifests" and harm == "manifest":
            rows = rows.filter("part > 0")
        rows.write.parquet(f"{other}/{name}")
    assert token_store.read_sums(spark, store, "<u2").count() == len(corpus())
    for read in (token_store.read_sums, token_store.read_ids):
        with pytest.raises(ValueError, match=says):
            read(spark, other, "<u2").collect()


def test_merkle_roots_tell_order_number_and_depth():
    names = [bytes([k]) for k in range(9)]
    roots = {token_store.merkle(names[:k]) for k in range(10)} | {token_store.merkle(names[::-1]), token_store.merkle([*names, names[-1]]), token_store.merkle([token_store.merkle(names[:2]), *names[2:]])}
    assert len(roots) == 13


def test_crc_of_joined_strings():
    a, b = b"some bytes", b"and others" * 50
    assert token_store.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 20_000])
def test_chunks_are_within_bounds(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n, np.uint16)
    ends = token_store.cuts(token_store._marks(ids, token_store.mixed(np.arange(50_257))).tolist(), 0, n)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == n and all(s <= token_store.MOST for s in sizes) and all(s >= token_store.LEAST for s in sizes[:-1])


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op1_bpe(spark, str(tmp_path)).count() == 0
    assert queries.op5_token_store(spark, str(tmp_path)).count() == 0
