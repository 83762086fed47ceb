"""Cut a text into the pre-tokens of a byte-level BPE vocabulary, and memoise the ids of each.

A text is first cut before each space; a cut there is always a pre-token border unless a space stands
between two white spaces (or ends the text after one), and such texts are matched whole instead.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pre-token pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kept per worker: pre-tokens, and space-cut pieces, of which the first half is kept for good.
MEMO_WORDS, MEMO_PIECES = 250_000, 900_000
#: Pre-tokens and pieces over this length aren't kept.
MEMO_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token bytes by id, merge parents and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], {c: b for b, c in enumerate(byte_symbols())}
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.parents: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.parents[ids[a + b]] = (ids[a], ids[b])
            self.rank[ids[a + b]] = r
        self.ordinary = sorted(ids.values())
        self.width = np.dtype("<u2") if size <= 65_536 else np.dtype("<u4")


class Memo:
    """Ids of texts as bytes of the vocabulary's width; encode gets a list of unseen pre-tokens and gives an id list each.

    Where there is encode_words, unseen pieces go to it by their pre-tokens, in a row: it gives the ids, as bytes, from each
    that begins with a space up to the next one.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int], width: np.dtype, encode_words: Callable[[list[str]], list[bytes]] | None = None):
        self.encode, self.width, self.encode_words = encode, width, encode_words
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.find_ascii = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(r"\p{N}", "0-9").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall
        self.find = regex.compile(PATTERN).findall
        self.unsafe = re.compile(r"\s (?:\s|\Z)").search
        self.special = {k: np.array([v], width).tobytes() for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.words) > MEMO_WORDS:
            self.words = {}
        known, width = self.words, self.width
        unseen = [w for w in dict.fromkeys(words) if w not in known]
        if unseen:
            coded = [array(width.char, ids).tobytes() for ids in self.encode(unseen)]
            if len(max(unseen, key=len)) > MEMO_CHARS:
                known = known | dict(zip(unseen, coded, strict=True))
                self.words.update((w, b) for w, b in zip(unseen, coded, strict=True) if len(w) <= MEMO_CHARS)
            else:
                known.update(zip(unseen, coded, strict=True))
        return [known[w] for w in words]

    def _cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; letters after a space or none are one, and ASCII needs no Unicode classes."""
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return [piece]
        return self.find_ascii(piece) if piece.isascii() else self.find(piece)

    def _whole(self, text: str) -> bytes:
        return b"".join(self._words(self.find(text)))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        known = self.pieces
        if len(known) > MEMO_PIECES:
            # the first half holds what is frequent: it was met early
            known = self.pieces = dict(islice(known.items(), MEMO_PIECES // 2))
        got = list(map(known.get, pieces))
        unseen = [i for i, ids in enumerate(got) if ids is None]
        if self.encode_words is not None and unseen:
            # pieces without white space in them can be cut and coded together: each begins with the space before it
            plain = [i for i in unseen if len(p := pieces[i]) <= MEMO_CHARS and p.isprintable() and p and p[0] != " "]
            ascii_, other = [], []
            for i in plain:
                (ascii_ if pieces[i].isascii() else other).append(i)
            for own, find in ((ascii_, self.find_ascii), (other, self.find)):
                if own:
                    texts = [pieces[i] for i in own]
                    ids = self.encode_words(find(" " + " ".join(texts)))
                    known.update(zip(texts, ids, strict=True))
                    for i, x in zip(own, ids, strict=True):
                        got[i] = x
            unseen = [i for i in unseen if got[i] is None]
        found = [self._cut(p[2:] if p[:2] == "  " else " " + p) for p in (pieces[i] for i in unseen)]
        flat = iter(self._words([w for ws in found for w in ws]))
        for i, ws in zip(unseen, found, strict=True):
            got[i] = ids = next(flat) if len(ws) == 1 else b"".join([next(flat) for _ in ws])
            if len(pieces[i]) <= MEMO_CHARS:
                known[pieces[i]] = ids
        return got

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special strings. Each different piece is looked up once; the texts are put together over arrays."""
        out: list[bytes | None] = [None] * len(texts)
        safe = []
        for i, t in enumerate(texts):
            if self.unsafe(t):
                out[i] = self._whole(t)
            else:
                safe.append(i)
        if not safe:
            return out
        parts = pc.split_pattern(pa.array([texts[i] for i in safe], pa.large_string()), " ")
        begin = parts.offsets.to_numpy()
        coded = parts.values.slice(int(begin[0]), int(begin[-1] - begin[0])).dictionary_encode()
        begin = begin - begin[0]
        code, follows = coded.indices.to_numpy().astype(np.int64), np.ones(int(begin[-1]), bool)
        follows[begin[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[code[follows]] = True
        # what follows a space is kept under its own text, the first piece with a mark that no piece can hold
        firsts = ["  " + p if p else None for p in parts.values.take(pa.array(begin[:-1] + parts.offsets[0].as_py())).to_pylist()]
        marked = list(dict.fromkeys(p for p in firsts if p))
        number = {p: i for i, p in enumerate(marked, len(used))}
        # no piece has a space in it, and one long text is taken out of Arrow much faster than many short ones
        names = pc.binary_join(pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        wanted = np.flatnonzero(used).tolist()
        ids = self._known([*(names[i] for i in wanted), *marked])
        size = np.zeros(len(used) + len(marked) + 1, np.int64)
        place = np.array([*wanted, *range(len(used), len(used) + len(marked))], np.int64)
        size[place] = np.array([len(x) for x in ids], np.int64) // self.width.itemsize
        start = np.zeros(len(size), np.int64)
        start[place] = np.cumsum(size[place]) - size[place]
        code[begin[:-1]] = [number[p] if p else len(size) - 1 for p in firsts]
        each = size[code]
        ends = np.cumsum(each)
        tokens = np.frombuffer(b"".join(ids), self.width)[np.repeat(start[code] - ends + each, each) + np.arange(int(each.sum()))]
        whole, bounds = tokens.tobytes(), np.append(0, ends)[begin] * self.width.itemsize
        for i, a, b in zip(safe, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = whole[a:b]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text; null counts as empty."""
        out: list[bytes | None] = []
        plain: list[str] = []
        for t in texts:
            if self.cut is not None and t and any(s in t for s in self.special):
                out.append(b"".join(self.special[p] if p in self.special else self._plain([p])[0] for p in self.cut(t) if p))
            else:
                out.append(None)
                plain.append(t or "")
        done = iter(self._plain(plain))
        return [next(done) if x is None else x for x in out]
