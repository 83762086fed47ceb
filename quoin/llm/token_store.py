"""Token ids on disk as a content-addressed store.

Each document's ids, with an end id, are cut where a rolling hash of the last ids says so, hence alike wherever
the same ids stand. A chunk is named by the digest of its bytes and stored once (<store>/chunks); a recipe per
document lists its chunks and holds their Merkle root (<store>/recipes, ascending doc_id); a manifest for each part
of the recipes holds the Merkle root of its documents, in order (<store>/manifests), and <store>/root that of all
manifests. Reading checks all of this: chunks against their names, recipes against their roots, the recipes of each
part against its manifest, and the manifests against the store's root; what is lost, doubled, swapped or altered is
an error.

Ids are those of the tokenizers library's model, asked for each pre-token (many at once, with a byte between them that no
token joins). Pre-tokens are cut by the vocabulary's own pattern, told in pretokens.py, so that ids can be remembered.

Null texts count as empty and hold the end id alone. Rows that share a doc_id are documents of their own, in any
order among themselves; null ids come first. Further columns aren't stored. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import ARROW_BYTES, ARROW_ROWS, dropped, looked_up, map_batches, partitions, stored
from quoin.llm.pretokens import Memo, Vocabulary, byte_symbols

#: Ids that the rolling hash sees; bounds and mean (a power of two) of a chunk's ids.
WINDOW, LEAST, MEAN, MOST = 8, 64, 512, 4096
#: Pre-tokens that the library's model sees at once.
WORDS = 100

_memos: dict[str, tuple[Vocabulary, Memo]] = {}


def library_memo(path: str) -> tuple[Vocabulary, Memo]:
    """Ids by the tokenizers library, asked once for each pre-token while it is remembered."""
    if path not in _memos:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # pre-tokens are cut already: the library's model takes them in its alphabet of bytes
        model, vocabulary = Tokenizer.from_file(path).model, Vocabulary(path)
        whole_rows = Tokenizer(model).encode_batch_fast
        letters = {b: c for b, c in enumerate(byte_symbols()) if chr(b) != c}
        others = re.compile("[" + "".join(re.escape(chr(b)) for b in letters if b != 32) + "]").search

        def encode(words: list[str]) -> list[list[int]]:
            out = []
            for w in words:
                if not (w.isascii() and w.isprintable()):
                    w = w.encode().decode("latin-1")
                    w = w.translate(letters) if others(w) else w
                out.append([t.id for t in model.tokenize(w.replace(" ", letters[32]))])
            return out

        symbols = np.array([ord(c) for c in byte_symbols()], np.uint32)
        # a byte that no text has, as UTF-8 doesn't, and that no token has beside others: what it parts is never joined
        apart = 0xFF
        border = [i for i, b in enumerate(vocabulary.token_bytes) if apart in b]
        mark = "\udcff"  # which is that byte once it is encoded

        def encode_words(words: list[str]) -> list[bytes]:
            rows = []
            for k in range(0, len(words), WORDS):
                raw = np.frombuffer(mark.join(words[k : k + WORDS]).encode("utf-8", "surrogateescape"), np.uint8)
                rows.append(symbols[raw].tobytes().decode("utf-32-le"))
            ids: list[int] = []
            for k in range(0, len(rows), WORDS):
                for e in whole_rows(rows[k : k + WORDS], add_special_tokens=False):
                    ids += e.ids
                    ids.append(border[0])
            starts = np.array([w[0] == " " for w in words], bool)
            coded = np.array(ids, vocabulary.width)
            kept = coded != border[0]
            # words end at borders; those that begin with a space begin a piece
            ends = np.cumsum(kept)[~kept] * coded.itemsize
            whole, begins = coded[kept].tobytes(), np.append(0, ends[:-1])[starts].tolist()
            return [whole[a:b] for a, b in zip(begins, [*begins[1:], len(whole)], strict=True)]

        _memos[path] = vocabulary, Memo(encode, vocabulary.special, vocabulary.width, encode_words if len(border) == 1 and vocabulary.token_bytes[border[0]] == bytes([apart]) else None)
    return _memos[path]


def mixed(x):
    """Even 64-bit hashes of an unsigned array."""
    import numpy as np

    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _marks(ids, table):
    """Ends (exclusive) where the rolling hash allows a cut."""
    import numpy as np

    h = table[ids]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + 1


def cuts(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the ids from start to end, given the marks among them."""
    out, at = [], start
    for mark in marks:
        while mark - at > MOST:
            at += MOST
            out.append(at)
        if mark - at >= LEAST:
            out.append(at := mark)
    while end - at > MOST:
        at += MOST
        out.append(at)
    if at < end:
        out.append(end)
    return out


def chunked(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row (row, doc_id, pos, name, n, payload) for each chunk."""
    import numpy as np

    def run(batches):
        vocabulary, memo = library_memo(path)
        width = vocabulary.width
        end, table = np.array([end_id], width).tobytes(), mixed(np.arange(len(vocabulary.token_bytes)))
        for cols in batches:
            coded = memo.ids(cols["text"])
            buffer = memoryview(end.join([*coded, b""]))
            # documents stand end to end: no chunk is short enough for the hash to look back into the one before
            marks = _marks(np.frombuffer(buffer, width), table)
            ends = np.cumsum([len(b) // width.itemsize + 1 for b in coded])
            own = np.searchsorted(marks, ends, side="left")
            marks, out, start, first = marks.tolist(), [], 0, 0
            for row, doc_id, stop, last in zip(cols["row"], cols["doc_id"], ends.tolist(), own.tolist(), strict=True):
                for pos, to in enumerate(cuts(marks[first:last], start, stop)):
                    out.append((row, doc_id, pos, to - start, bytes(buffer[start * width.itemsize : to * width.itemsize])))
                    start = to
                first = last
            row, doc_id, pos, n, payload = map(list, zip(*out, strict=True)) if out else ([],) * 5
            yield {"row": row, "doc_id": doc_id, "pos": pos, "name": [hashlib.blake2b(p, digest_size=16).digest() for p in payload], "n": n, "payload": payload}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "row long, doc_id long, pos int, name binary, n int, payload binary", 4 * ARROW_ROWS, 4 * ARROW_BYTES)


class Merkle:
    """A Merkle tree built from the left, of which only the roots of whole subtrees are held. Leaves and inner nodes are hashed apart."""

    def __init__(self):
        self.roots: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.blake2b(b"\0" + leaf, digest_size=16).digest()
        while self.roots and self.roots[-1][0] == height:
            height, node = height + 1, hashlib.blake2b(b"\1" + self.roots.pop()[1] + node, digest_size=16).digest()
        self.roots.append((height, node))

    def root(self) -> bytes:
        if not self.roots:
            return hashlib.blake2b(b"", digest_size=16).digest()
        node = self.roots[-1][1]
        for _, left in reversed(self.roots[:-1]):
            node = hashlib.blake2b(b"\1" + left + node, digest_size=16).digest()
        return node


def merkle(leaves: Iterable[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def manifests(recipes: DataFrame) -> DataFrame:
    """(part, documents, n_tokens, root) of the recipes as they are: root over the documents of a part, in order."""

    def run(batches):
        part, tree, documents, tokens = None, Merkle(), 0, 0

        def told():
            return {"part": [part], "documents": [documents], "n_tokens": [tokens], "root": [tree.root()]}

        for cols in batches:
            for p, doc_id, row, n, root in zip(*(cols[c] for c in ("part", "doc_id", "row", "n_tokens", "root")), strict=True):
                if p != part:
                    if part is not None:
                        yield told()
                    part, tree, documents, tokens = p, Merkle(), 0, 0
                tree.add(f"{doc_id}:{row}:{n}:".encode() + root)
                documents, tokens = documents + 1, tokens + n
        if part is not None:
            yield told()

    own = recipes.select("part", "doc_id", "row", "n_tokens", "root").repartition(partitions(recipes.sparkSession), "part").sortWithinPartitions("part", "doc_id", "row")
    return map_batches(own, run, "part int, documents long, n_tokens long, root binary")


def root_of(rows: list) -> bytes:
    """The store's root, from the rows of its manifests: as many as the recipes were written in parts."""
    return merkle(f"{r.part}:{r.documents}:{r.n_tokens}:".encode() + bytes(r.root) for r in sorted(rows, key=lambda r: r.part))


def verified(spark: SparkSession, store: str) -> DataFrame:
    """The recipes, once they were found to be what the manifests and the store's root say."""
    recipes, told = spark.read.parquet(f"{store}/recipes"), spark.read.parquet(f"{store}/manifests").collect()
    if [bytes(r.root) for r in spark.read.parquet(f"{store}/root").collect()] != [root_of(told)]:
        raise ValueError(f"the manifests of {store} aren't those of its root")
    key = lambda r: (r.part, r.documents, r.n_tokens, bytes(r.root))
    if wrong := set(map(key, told)) ^ set(map(key, manifests(recipes).collect())):
        raise ValueError(f"recipes of {store} aren't those of its manifests, in parts {sorted({x[0] for x in wrong})}")
    return recipes


def write(docs: DataFrame, store: str, path: str, end_id: int) -> None:
    """Encode docs (doc_id, text) with the tokenizer file at path into a new store."""
    spark = docs.sparkSession
    cut = stored(chunked(docs, path, end_id), "chunked")
    # a chunk that fills the corpus is folded before it moves: each task sends it once
    cut.groupBy("name").agg(F.first("n").alias("n"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{store}/chunks")
    listed = cut.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("n").cast("long")).alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "name", "n"))).alias("chunks"))
    plain = listed.select("doc_id", "row", "n_tokens", F.col("chunks.name").alias("names"), F.col("chunks.n").alias("sizes"))
    ordered = plain.repartitionByRange(partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())

    def rooted(batches):
        for cols in batches:
            yield cols | {"root": [merkle(x) for x in cols["names"]]}

    map_batches(ordered, rooted, "doc_id long, row long, n_tokens long, names array<binary>, sizes array<int>, part int, root binary").write.option("compression", "zstd").parquet(f"{store}/recipes")
    manifests(spark.read.parquet(f"{store}/recipes")).coalesce(1).write.parquet(f"{store}/manifests")
    told = spark.read.parquet(f"{store}/manifests").collect()
    spark.createDataFrame([(root_of(told), len(told))], "root binary, parts int").coalesce(1).write.parquet(f"{store}/root")
    dropped(spark, cut)


def placed(recipes: DataFrame) -> DataFrame:
    """recipes with start, the ids of all documents before each."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.select("part", "doc_id", "row", "n_tokens").join(parts, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return starts.select("row", "doc_id", "n_tokens", "start")


@lru_cache(65_536)
def shift_factor(n_bytes: int) -> int:
    """x to the power of eight times n_bytes, modulo the CRC-32 polynomial (bits reversed)."""
    out, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = times(out, square)
        square = times(square, square)
        n >>= 1
    return out


def times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reversed."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two strings one after the other, from the crc32 of each."""
    return times(shift_factor(second_bytes), first) ^ second


def chunk_sums(store: DataFrame, width: str) -> DataFrame:
    """(name, n, crc) of every stored chunk, crc over little-endian 32-bit ids; a chunk that isn't what its name says is an error."""
    import numpy as np

    def run(batches):
        for cols in batches:
            crcs = []
            for name, n, payload in zip(cols["name"], cols["n"], cols["payload"], strict=True):
                ids = np.frombuffer(payload, width)
                if len(ids) != n or hashlib.blake2b(payload, digest_size=16).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield {"name": cols["name"], "n": cols["n"], "crc": crcs}

    return map_batches(store.select("name", "n", "payload"), run, "name binary, n int, crc long")


def width_of(path: str) -> str:
    return Vocabulary(path).width.str


def read_ids(spark: SparkSession, store: str, width: str) -> DataFrame:
    """(doc_id, row, ids): every document put together again, ids as little-endian unsigned integers of width."""
    parts = verified(spark, store).select("doc_id", "row", F.posexplode("names").alias("pos", "name"))
    found = parts.join(spark.read.parquet(f"{store}/chunks").select("name", "payload"), "name", "left")
    whole = found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    return whole.select("doc_id", "row", F.expr("aggregate(parts.payload, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))


def read_sums(spark: SparkSession, store: str, width: str) -> DataFrame:
    """(doc_id, row, start, n_tokens, ids_crc32) of every document, from the files.

    Only sums of the chunks travel to the recipes: the crc32 of a document is joined from those of its chunks.
    """
    recipes = verified(spark, store)
    sums = chunk_sums(spark.read.parquet(f"{store}/chunks"), width)
    parts = stored(recipes.select("row", "root", F.posexplode("names").alias("pos", "name")), "parts")
    named = looked_up(parts, stored(sums, "sums"), ["name"], "left")
    whole = named.groupBy("row").agg(F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("pos", "name", "n", "crc"))).alias("parts"))
    flat = whole.select("row", "root", F.col("parts.name").alias("names"), F.col("parts.n").alias("sizes"), F.col("parts.crc").alias("crcs"))

    def run(batches):
        for cols in batches:
            out = []
            for root, names, sizes, crcs in zip(cols["root"], cols["names"], cols["sizes"], cols["crcs"], strict=True):
                if None in crcs or merkle(names) != root:
                    raise ValueError("a recipe doesn't match its root or lacks a chunk")
                crc = 0
                for n, c in zip(sizes, crcs, strict=True):
                    crc = joined_crc(crc, c, 4 * n)
                out.append(crc)
            yield {"row": cols["row"], "found": [sum(x) for x in cols["sizes"]], "ids_crc32": out}

    checked = map_batches(flat, run, "row long, found long, ids_crc32 long")
    return placed(recipes).join(checked, "row").select("doc_id", "row", "start", F.col("found").alias("n_tokens"), "ids_crc32")
