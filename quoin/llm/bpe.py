"""BPE encoding and decoding without running merges.

In a BPE code the last token of every prefix is unique: it is the one token ending there that may follow
the last token of the shorter prefix left before it. So the code of a text is found by one pass that stores
that token for each prefix, and read off backwards. The tokens ending at a position come from a suffix
automaton of the vocabulary; whether two tokens may stand side by side is tested on their merge trees.

Null texts count as empty and have no ids. Texts of any length, repeated rows, further columns and empty
tables need nothing special: each row is coded by itself, and other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quoin.llm.common import map_batches
from quoin.llm.pretokens import Memo, Vocabulary
from quoin.llm.suffix_automaton import SuffixAutomaton

#: Results of pair tests kept per worker.
MEMO_PAIRS = 300_000


class TokenAutomaton(SuffixAutomaton):
    """Of all tokens; the state reached by a text has the tokens that end at its last byte."""

    def __init__(self, tokens: dict[int, bytes]):
        super().__init__(tokens.values())
        own: dict[int, list[tuple[int, int]]] = {}
        for i, token in tokens.items():
            state = 0
            for byte in token:
                state = self.next[state][byte]
            own.setdefault(state, []).append((len(token), i))
        #: By state: (length, id) of the tokens that end here, longest first, those along the links included.
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            beyond = self.tokens[self.link[state]]
            self.tokens[state] = (*sorted(own[state], reverse=True), *beyond) if state in own else beyond


class PrefixCoder:
    def __init__(self, vocabulary: Vocabulary):
        self.automaton = TokenAutomaton({i: vocabulary.token_bytes[i] for i in vocabulary.ordinary})
        self.rank, self.parents = vocabulary.rank, vocabulary.parents
        self.merged = {(a, b): vocabulary.rank[i] for i, (a, b) in vocabulary.parents.items()}
        self.pairs: dict[int, bool] = {}

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right apart when they meet.

        Their merge trees are undone from the latest merge backwards; had a merge across the border been
        possible before the merge undone last, the two tokens would never have come about.
        """
        rank, parents, merged, none = self.rank, self.parents, self.merged, -1
        before = len(rank)
        while True:
            if merged.get((left, right), before) < before:
                return False
            a, b = rank.get(left, none), rank.get(right, none)
            if a == b == none:
                return True
            if a > b:
                # at equal rank the merge further left comes first; an earlier merge on the right stands
                before, left = a, parents[left][1]
            else:
                before, right = b + 1, parents[right][0]

    def code(self, text: bytes) -> list[int]:
        automaton, pairs = self.automaton, self.pairs
        steps, link, length, tokens = automaton.next, automaton.link, automaton.length, automaton.tokens
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        last, sizes = [0], [0]
        state = matched = 0
        for end, byte in enumerate(text, 1):
            while (to := steps[state].get(byte)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                raise ValueError(f"no token of the vocabulary has byte {byte}")
            state = to
            matched += 1
            for size, token in tokens[state]:
                if size > matched:
                    continue
                if size == end:
                    break
                pair = last[end - size] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.side_by_side(last[end - size], token)
                if fits:
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends with byte {byte}")
            last.append(token)
            sizes.append(size)
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]


_coders: dict[str, tuple[Vocabulary, Memo]] = {}
_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One per Python worker; those that only decode need no automaton."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def coder(path: str) -> tuple[Vocabulary, Memo]:
    """One per Python worker and vocabulary file."""
    if path not in _coders:
        vocabulary = vocabulary_of(path)
        prefix = PrefixCoder(vocabulary)
        _coders[path] = vocabulary, Memo(lambda words: [prefix.code(w.encode()) for w in words], vocabulary.special, vocabulary.width)
    return _coders[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of token ids, little-endian unsigned 32-bit, in place of the text.

    path: a byte-level BPE tokenizer file, on every executor. Strings of its special tokens become those tokens.
    """
    import numpy as np

    schema = T.StructType([*(f for f in docs.schema if f.name not in (text, ids)), T.StructField(ids, T.BinaryType())])

    def run(batches):
        vocabulary, memo = coder(path)
        for cols in batches:
            texts = cols.pop(text)
            yield cols | {ids: [np.frombuffer(b, vocabulary.width).astype("<u4").tobytes() for b in memo.ids(texts)]}

    return map_batches(docs.drop(ids) if ids != text else docs, run, schema)


def _text(b: bytes | None, pieces) -> str:
    import numpy as np

    return b"".join(map(pieces, np.frombuffer(b or b"", "<u4").tolist())).decode("utf-8", "replace")


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """coded with the text that its ids stand for; bytes that aren't UTF-8 become U+FFFD. Null ids: empty."""
    schema = T.StructType([*(f for f in coded.schema if f.name != text), T.StructField(text, T.StringType())])

    def run(batches):
        pieces = vocabulary_of(path).token_bytes.__getitem__
        for cols in batches:
            yield cols | {text: [_text(b, pieces) for b in cols[ids]]}

    return map_batches(coded.drop(text), run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """encode(), and the text decoded from the ids in place of the original, in one pass over the documents."""
    import numpy as np

    schema = T.StructType([*(f for f in docs.schema if f.name not in (text, ids)), T.StructField(ids, T.BinaryType()), T.StructField(text, T.StringType())])

    def run(batches):
        vocabulary, memo = coder(path)
        pieces = vocabulary.token_bytes.__getitem__
        for cols in batches:
            coded = [np.frombuffer(b, vocabulary.width).astype("<u4").tobytes() for b in memo.ids(cols.pop(text))]
            yield cols | {ids: coded, text: [_text(b, pieces) for b in coded]}

    return map_batches(docs, run, schema)
