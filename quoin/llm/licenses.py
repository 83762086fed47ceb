"""Scan texts for licences by templates with optional and replaceable regions.

Markup: words stand for themselves (whatever is between them in a text, letter case and marks are not compared),
`[[...]]` is a region that may be left out, and `{{a-b}}` is replaceable by any a to b words. All templates, and the
phrases, which are templates of words only, become one automaton over words: its positions are the words of the markup,
and sets of positions are made as texts need them, in a bounded table. A place of a text is accepted if the mandatory
wording stands there exactly. Texts go through word by word, in pieces of bounded size, so their length doesn't matter.

Null and empty texts have no words. Rows are treated one by one: repeated rows, ties and rows that share an id need
nothing special, and no row moves. Columns of docs other than those that scanned() makes are carried along; columns of
those names are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quoin.llm.common import map_batches

#: A-Z to a-z, other ASCII than digits and a-z to a space; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters of a text that are made words at once.
PIECE = 1 << 20
#: Sets of positions in the automaton's table, and steps between them; a full table is begun anew.
SETS, STEPS = 20_000, 400_000

# Phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Public licence texts and the notices that refer to them, with what may be left out or replaced.
TEMPLATES = (
    ("mit", "under the [[terms of the]] mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this {{1-4}} and associated documentation files the {{1-4}} to deal
        in the {{1-4}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the {{1-4}} and to permit persons to whom the {{1-4}} is furnished to do so subject to the following conditions the above copyright notice and
        this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{1-4}}"""),
    ("mit-0", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
        in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the software and to permit persons to whom the software is furnished to do so the software is provided as is"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution this software is provided by {{1-12}} as is"""),
    ("bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution [[3]] neither the name of {{1-12}} nor the names of [[its]] {{0-4}} contributors may be used to endorse
        or promote products derived from this software without specific prior written permission"""),
    ("zlib", """permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
        subject to the following restrictions"""),
    ("apache-2.0", "under the [[terms of the]] apache license [[version]] 2 0"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this {{1-4}} except in compliance with the license
        you may obtain a copy of the license at"""),
    ("gpl-2.0", "under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2"),
    ("gpl-3.0", "under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-or-later", """under the terms of the gnu general public license as published by the free software foundation either version {{1-2}} of the license
        or at your option any later version"""),
    ("lgpl", "under the [[terms of the]] gnu lesser general public license [[as published by the free software foundation]] [[either]] version {{1-2}}"),
    ("agpl-3.0", "under the [[terms of the]] gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "under [[a]] [[the]] {{0-2}} cc by 4 0"),
    ("cc-by-nc-4.0", "under [[a]] [[the]] {{0-2}} cc by nc 4 0"),
    ("cc-by-sa-4.0", "under [[a]] [[the]] {{0-2}} cc by sa 4 0"),
    ("cc-by-4.0", "under [[a]] [[the]] creative commons attribution 4 0 international"),
    ("cc-by-nc-4.0", "under [[a]] [[the]] creative commons attribution non commercial 4 0 international"),
    ("cc-by-sa-4.0", "under [[a]] [[the]] creative commons attribution share alike 4 0 international"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

Parsed = list  # of words (bytes), (least, most) for replaceable regions and lists for optional ones


def parsed(markup: str) -> Parsed:
    """The markup as a list: words, (least, most), lists of what may be left out."""
    open_: list[Parsed] = [[]]
    for begin, end, least, most, other in re.findall(r"(\[\[)|(\]\])|\{\{(\d+)-(\d+)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", markup, re.S):
        if begin:
            open_.append([])
        elif end:
            if len(open_) < 2:
                raise ValueError(f"a region is closed that isn't open: {markup[:60]}")
            region = open_.pop()
            open_[-1].append(region)
        elif most:
            open_[-1].append((int(least), int(most)))
        else:
            open_[-1].extend(words(other))
    if len(open_) > 1:
        raise ValueError(f"a region isn't closed: {markup[:60]}")
    return open_[0]


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def pieces(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    text, rest = text or "", b""
    for at in range(0, len(text), size):
        piece = rest + text[at : at + size].encode().translate(_FOLD)
        found, rest = piece.split(), b""
        if found and not piece.endswith(b" ") and at + size < len(text):
            rest = found.pop()
        yield found


class Automaton:
    """Templates as one automaton over words, which finds every place where one ends."""

    def __init__(self, templates: list[tuple[str, Parsed, bool]]):
        """templates: label, markup and whether it is a phrase."""
        #: The word of each position (None: any), the positions that may come next, what ends there.
        self.word: list[bytes | None] = []
        self.next: list[set[int]] = []
        self.ends: dict[int, list[tuple[str, int]]] = {}
        self.first: set[int] = set()
        for label, items, phrase in templates:
            first, last, empty = self._placed(items)
            if empty:
                raise ValueError(f"nothing of {label} is mandatory")
            self.first |= first
            for p in last:
                self.ends.setdefault(p, []).append((label, len(items) if phrase else 0))
        self.names = [None, *sorted({w for w in self.word if w is not None})]
        self.known = {w: i for i, w in enumerate(self.names) if i}
        self.at_first = self._by_word(self.first)
        self._begin()

    def _position(self, word: bytes | None) -> tuple[set[int], set[int], bool]:
        self.word.append(word)
        self.next.append(set())
        return {len(self.word) - 1}, {len(self.word) - 1}, False

    def _placed(self, items: Parsed) -> tuple[set[int], set[int], bool]:
        """Positions that may come first and last, and whether there may be none."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for item in items:
            if isinstance(item, bytes):
                parts = [self._position(item)]
            elif isinstance(item, tuple):
                parts = [(*self._position(None)[:2], i >= item[0]) for i in range(item[1])]
            else:
                parts = [(*self._placed(item)[:2], True)]
            for f, l, e in parts:  # noqa: E741
                for p in last:
                    self.next[p] |= f
                first = first | f if empty else first
                last = last | l if e else l
                empty = empty and e
        return first, last, empty

    def _by_word(self, positions: set[int]) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {}
        for p in positions:
            out.setdefault(self.known[self.word[p]] if self.word[p] is not None else -1, set()).add(p)
        return out

    def _begin(self) -> None:
        """An empty table."""
        self.sets: list[frozenset[int]] = [frozenset()]
        self.number = {frozenset(): 0}
        self.steps: list[dict[int, int]] = [{}]
        self.told: list[list[tuple[str, int]]] = [[]]
        self.taken = 0

    def _step(self, state: int, word: int) -> int:
        """The number of the set that follows."""
        onward = self.at_first.get(word, set()) | self.at_first.get(-1, set())
        for p in self.sets[state]:
            onward = onward | {q for q in self.next[p] if self.word[q] is None or word and self.word[q] == self.names[word]}
        then = frozenset(onward)
        if self.taken >= STEPS or len(self.sets) >= SETS:
            self._begin()
            keep = False  # the state that was left isn't in the new table
        else:
            keep = True
        if then not in self.number:
            self.number[then] = len(self.sets)
            self.sets.append(then)
            self.steps.append({})
            self.told.append(sorted({e for p in then for e in self.ends.get(p, [])}))
        to = self.number[then]
        if keep:
            self.steps[state][word] = to
            self.taken += 1
        return to

    def read(self, text: str | None, size: int = PIECE) -> tuple[int, list[tuple[str, int, int]]]:
        """Number of words, and (label, last word, words of the phrase or 0) of every place."""
        n, state, found, known = 0, 0, [], self.known.get
        for piece in pieces(text, size):
            for at, w in enumerate(piece, n):
                word = known(w, 0)
                try:
                    state = self.steps[state][word]
                except KeyError:
                    state = self._step(state, word)
                if state and self.told[state]:
                    found.extend((label, at, length) for label, length in self.told[state])
            n += len(piece)
        return n, found


MADE = T.StructType([
    *(T.StructField(name, T.LongType()) for name in ("n_words", "n_base", "first_word", "last_word")),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("accepted", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("last", T.LongType())]))),
])


def judged(automaton: Automaton, text: str | None) -> tuple:
    """The values of MADE. Score: 1 where a template is accepted, a half where phrases alone are found, else 0."""
    n, found = automaton.read(text)
    starts = [last - length + 1 for _, last, length in found if length]
    base = sorted({label for label, _, length in found if length})
    own = [(label, last) for label, last, length in found if not length]
    labels = sorted({*base, *(label for label, _ in own)})
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1.0 if own else 0.5 if base else 0.0, [{"label": label, "last": last} for label, last in own]


def scanned(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, keep_text: bool = True) -> DataFrame:
    """docs (without the text, if it isn't kept) with the columns of MADE; accepted has each place where a template's last word stands."""
    compiled = [*((label, parsed(markup), False) for label, markup in templates), *((label, parsed(words_), True) for label, words_ in phrases)]
    Automaton(compiled)  # refuses bad markup here rather than in tasks
    kept = [f for f in docs.schema if f.name not in MADE.names]
    gone = set() if keep_text else {text}

    def run(batches):
        automaton = Automaton(compiled)
        for cols in batches:
            told = [judged(automaton, t) for t in cols[text]]
            yield {c: v for c, v in cols.items() if c not in gone} | {name: [x[i] for x in told] for i, name in enumerate(MADE.names)}

    return map_batches(docs.select(*(f.name for f in kept)), run, T.StructType([*(f for f in kept if f.name not in gone), *MADE]))
