"""Group spelling variants: words one edit apart, by Levenshtein automata of distance one over tries.

Words are counted by Spark. The counted words are sorted into ranges; each range becomes a few compact tries of bounded
size (single ways to a word kept as one string), stored as rows. The tries are sent one after the other: every word's
automaton meets the trie depth first, and what it accepts is reduced to the number of near words and the best one, so no
pair of words is ever written. Forms are followed to their roots by doubling.

Null texts have no words; a null id is damaged as an empty one. Repeated rows count as often as they occur. With no
words the result is empty. Other columns are ignored. A word that is longer than a trie may be has a trie of its own.
"""

from __future__ import annotations

import marshal
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import dropped, fresh_path, map_batches, partitions, scratch, stored

#: Words of a trie, and their characters together, at most: some 100 MB in a worker.
TRIE_WORDS, TRIE_CHARS = 300_000, 6_000_000
#: Words shorter or rarer than this take no part.
LENGTH, OCCURRENCES = 5, 3
#: Damage: one run in so many loses a character.
DAMAGED = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, run: Column) -> Column:
    """The run without its character at h % length, where h, the crc32 of `<doc_id>:<run>`, is a multiple of DAMAGED."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all words that are long and frequent enough, as damaged()."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


Trie = list[dict]


def trie_of(words: list[tuple[str, int]]) -> Trie:
    """A trie of words with counts, as a list of nodes, the root first. A node is a dict of characters; "" has the count of the word that ends there.

    A character leads to a node's place in the list or, where only one word goes on, to (rest of the word, its count).
    """
    nodes: Trie = [{}]
    for word, n in words:
        node, i = nodes[0], 0
        while True:
            if i == len(word):
                node[""] = n
                break
            below = node.get(word[i])
            if below is None:
                node[word[i]] = (word[i + 1 :], n)
                break
            if type(below) is tuple:  # split the way, one step on at a time
                rest, m = below
                below = node[word[i]] = len(nodes)
                nodes.append({rest[0]: (rest[1:], m)} if rest else {"": m})
            node, i = nodes[below], i + 1
    return nodes


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one character is inserted, deleted or replaced between a and b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # length of the common prefix, by halves
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def accepted(word: str, trie: Trie) -> dict[str, int]:
    """The words of the trie at a distance of one from word, with their counts.

    The automaton's states are (position, errors). Without an error there is one way down the trie; each node on it opens
    the states with one error (a character of the trie is read in the place of the word's, or before it, or the word's is
    passed over), which go on exactly, depth first, until the automaton fails or accepts.
    """
    found: dict[str, int] = {}
    size, node, i = len(word), trie[0], 0

    def exactly(below: int | tuple[str, int] | None, at: int) -> int | None:
        while type(below) is int:
            if at == size:
                return trie[below].get("")
            below = trie[below].get(word[at])
            at += 1
        return below[1] if below is not None and len(below[0]) == size - at and word.endswith(below[0]) else None

    while True:
        here, after = word[i : i + 1], word[i + 1 : i + 2]
        if here and (n := node.get("") if not after else exactly(node.get(after), i + 2)) is not None:
            found[word[:i] + word[i + 1 :]] = n
        for c, below in node.items():
            if not c:
                continue
            if type(below) is int:
                there = trie[below]
                if here and c != here and after in there and (n := exactly(below, i + 1)) is not None:
                    found[word[:i] + c + word[i + 1 :]] = n
                if here in there and (n := exactly(below, i)) is not None:
                    found[word[:i] + c + word[i:]] = n
                continue
            rest, n = below
            more = len(rest) - size + i
            if more == -1 and here and c != here and word.endswith(rest):
                found[word[:i] + c + rest] = n
            elif more == 0 and word.endswith(rest):
                found[word[:i] + c + rest] = n
        below = node.get(here) if here else None
        if type(below) is not int:
            if below is not None and one_edit(word[i + 1 :], below[0]):
                found[word[: i + 1] + below[0]] = below[1]
            break
        node, i = trie[below], i + 1
    found.pop(word, None)
    return found


def shards(words: DataFrame, most_words: int = TRIE_WORDS, most_chars: int = TRIE_CHARS) -> DataFrame:
    """(shard, trie) rows: the words in their order, cut after so many words or characters, whatever partitions they are sorted in."""
    spark = words.sparkSession

    def placed(batches) -> Iterator[dict[str, list]]:
        at = chars = 0
        for cols in batches:
            size = [len(w) for w in cols["word"]]
            before = list(accumulate(size, initial=chars))
            yield {**cols, "at": list(range(at, at + len(size))), "chars": before[:-1]}
            at, chars = at + len(size), before[-1]

    ranges = words.repartitionByRange(partitions(spark), "word").sortWithinPartitions("word")
    ranked = stored(map_batches(ranges, placed, "word string, n long, at long, chars long").withColumn("range", F.spark_partition_id()), "ranked")
    ends = ranked.groupBy("range").agg((F.max("at") + 1).alias("words"), F.max(F.struct("at", F.col("chars") + F.char_length("word"))).getField("col2").alias("chars")).orderBy("range").collect()  # a row for each partition
    begin, n, chars = [], 0, 0
    for r in ends:
        begin.append((r.range, n, chars))
        n, chars = n + r.words, chars + r.chars
    offsets = F.broadcast(spark.createDataFrame(begin, "range int, words_before long, chars_before long"))
    cut = F.struct(F.floor((F.col("at") + F.col("words_before")) / most_words).alias("a"), F.floor((F.col("chars") + F.col("chars_before")) / most_chars).alias("b"))
    own = ranked.join(offsets, "range").select(cut.alias("shard"), "word", "n")

    def built(batches) -> Iterator[dict[str, list]]:
        shard, held = None, []
        for cols in batches:
            for s, word, n in zip(cols["shard"], cols["word"], cols["n"], strict=True):
                if held and s != shard:
                    yield {"shard": [shard], "trie": [marshal.dumps(trie_of(held))]}
                    held = []
                shard = s
                held.append((word, n))
        if held:
            yield {"shard": [shard], "trie": [marshal.dumps(trie_of(held))]}

    return map_batches(own.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "word"), built, "shard struct<a: long, b: long>, trie binary")


_kept: dict[str, Trie] = {}


@contextmanager
def _sent(words: DataFrame, trie: bytes):
    """What gives a worker the trie, for as long as it is needed; a worker keeps that of the last pass."""
    shared, part = words.sparkSession.sparkContext.broadcast(trie), uuid.uuid4().hex

    def get() -> Trie:
        if part not in _kept:
            _kept.clear()
            _kept[part] = marshal.loads(shared.value)
        return _kept[part]

    try:
        yield get
    finally:
        shared.destroy()


NEAR = "word string, n_near long, form string, form_n long"


def near(words: DataFrame, most_words: int = TRIE_WORDS, most_chars: int = TRIE_CHARS) -> DataFrame:
    """(word, n_near, form, form_n) of the words (stored: word, n) that have near ones: how many, and that of largest n (ties: smallest)."""
    built = stored(shards(words, most_words, most_chars), "tries")
    told = []
    for r in built.select("shard").orderBy("shard").collect():
        (row,) = built.filter((F.col("shard.a") == r.shard.a) & (F.col("shard.b") == r.shard.b)).collect()
        with _sent(words, row.trie) as trie:

            def run(batches, trie=trie):
                for cols in batches:
                    out: dict[str, list] = {"word": [], "n_near": [], "form": [], "form_n": []}
                    for word in cols["word"]:
                        if found := accepted(word, trie()):
                            n, form = min((-n, w) for w, n in found.items())
                            for name, value in zip(out, (word, len(found), form, -n), strict=True):
                                out[name].append(value)
                    yield out

            told.append(stored(map_batches(words.select("word"), run, NEAR), "near"))
    dropped(words.sparkSession, built)
    if not told:
        return words.sparkSession.createDataFrame([], NEAR)
    return told[0] if len(told) == 1 else _reduced(reduce(DataFrame.unionAll, told))


def _reduced(told: DataFrame) -> DataFrame:
    """What several tries tell of each word, as one row."""
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form"))
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.least")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word that forms lead to. Each round doubles the way that a word looks ahead."""
    spark = forms.sparkSession
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(spark, now)
        now = then
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, most_words: int = TRIE_WORDS, most_chars: int = TRIE_CHARS) -> DataFrame:
    """word, form, root string; n, n_near, form_n long, of all words of docs (doc_id, text)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "variants")
    with scratch(spark, path):
        words = stored(counted(docs), "words")
        joined = words.join(near(words, most_words, most_chars), "word", "left")
        enough = F.col("form_n") >= 2 * F.col("n")
        judged = stored(joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
        roots = rooted(judged.filter("form is not null"))
        made = judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)
