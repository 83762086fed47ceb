"""Language identification by cross-parsing.

For each language a suffix automaton holds all substrings of a sample of its texts. A text is parsed greedily, from
its start to its end, into the longest phrases that the automaton holds; the language that needs the fewest phrases
per letter wins.

Texts are parsed side by side, for several languages at once, so that a step is a table lookup over an array, and long
texts from many places at once: each segment is first parsed as if it began a phrase, then again from the state in
which the segment before really ends, until both parses are in one state, from where on they are the same. So what
is counted is the one parse of the whole text.

Texts that are null or without letters are `und`, with score 0; so are all texts if no labelled text was learned
from. Ties go to the language first by name. Texts of any length are parsed whole; repeated rows are rows of their
own, and further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import held_out, map_batches
from quoin.llm.suffix_automaton import SuffixAutomaton

#: Learned from: at most so many texts a language, whole ones, until they have so many letters together.
TEXTS, LETTERS = 64, 20_000
#: The most frequent letters, whose steps are a table; those of all further letters are found in a sorted list.
ALPHABET = 62
#: Letters of a segment; letters, and languages, parsed at once. No result depends on them.
SEGMENT, LOT, SIDE = 256, 1 << 20, 8
MISS = 1 << 30


def symbols(text: str, table, other: int | None = None):
    """0 for each run of other characters than letters, else the number of the letter."""
    import numpy as np

    s = table[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def letter_table(letters: str):
    """By code point: 0 no letter, 1 and more the known letters, then one number for all other letters, and one for padding."""
    import numpy as np

    table = np.array([len(letters) + 1 if chr(i).isalpha() else 0 for i in range(0x110000)], np.int32)
    for i, c in enumerate(letters, 1):
        table[ord(c)] = i
    return table


class Model:
    """steps: by state and column, the next state (both times the row's width), with MISS added where a phrase ends.

    A column is a frequent letter's number, one for all further letters, or one for padding; rare and rare_to are the
    steps by further letters: state * apart + number, sorted, and the next state.
    """

    def __init__(self, samples: dict[str, list[str]]):
        import numpy as np
        from collections import Counter

        self.languages = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        self.letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])))
        self.other, self.pad = len(self.letters) + 1, len(self.letters) + 2
        self.dense, self.apart = min(ALPHABET, len(self.letters)), self.pad + 1
        width, table = self.dense + 3, letter_table(self.letters)
        parts, self.roots, at, rare = [], [], 0, {}
        for language in self.languages:
            automaton = SuffixAutomaton(symbols(t, table).tolist() for t in samples[language])
            n = len(automaton.next)
            # before the root, a row for the place after a letter that the language lacks, which is a phrase of its own
            root = at + width
            steps = np.full((n + 1, width), -1, np.int64)
            for state, to in enumerate(automaton.next, 1):
                for c, x in to.items():
                    if c <= self.dense:
                        steps[state, c] = root + x * width
                    else:
                        rare[(at + state * width) * self.apart + c] = root + x * width
            first = np.where(steps[1] < 0, at, steps[1])
            steps = np.where(steps < 0, first + MISS, steps)
            steps[1] = first
            steps[:, self.dense + 2] = at + np.arange(n + 1) * width
            parts.append(steps.astype(np.int32).ravel())
            self.roots.append(root)
            at += (n + 1) * width
            if at >= MISS:
                raise ValueError("too many languages for one table of steps")
        self.rare = np.array(sorted(rare), np.int64)
        self.rare_to = np.array([rare[k] for k in sorted(rare)], np.int64)
        self.steps = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def further(self, states, letters, roots):
        """The steps by letters that aren't in the table, as in steps."""
        import numpy as np

        def found(states):
            keys = states.astype(np.int64) * self.apart + letters
            at = np.minimum(np.searchsorted(self.rare, keys), len(self.rare) - 1)
            return np.where(self.rare[at] == keys, self.rare_to[at], -1)

        roots = np.broadcast_to(roots, states.shape)
        first = found(roots)
        first = np.where(first >= 0, first, roots - (self.dense + 3))
        to = found(states)
        return np.where(to >= 0, to, first + np.where(states == roots, 0, MISS))

    def _parsed(self, texts: list, entry, roots):
        """Ends of phrases in each text by language, and the state after it, from the states at entry (by language and text)."""
        import numpy as np

        n = len(roots)
        pieces = np.array([-(-len(t) // SEGMENT) for t in texts])
        letters = np.full((int(pieces.sum()), SEGMENT), self.pad, np.int32)
        last = np.cumsum(pieces) - 1
        for at, k, t in zip((last - pieces + 1).tolist(), pieces.tolist(), texts, strict=True):
            letters[at : at + k].ravel()[: len(t)] = t
        goes_on = np.ones(len(letters), bool)
        goes_on[last - pieces + 1] = False
        letters = np.ascontiguousarray(letters.T)
        columns = np.where(letters <= self.dense, letters, self.dense + 1 + (letters == self.pad)).astype(np.int32)
        rare = (letters > self.dense) & (letters < self.other)
        some = rare.any(axis=1)

        # each segment as if it began a phrase
        state = np.repeat(roots[:, None], len(goes_on), axis=1)
        state[:, ~goes_on] = entry
        after = np.empty((SEGMENT, *state.shape), np.int32)
        for i, column in enumerate(columns):
            to = self.steps[state + column]
            if some[i]:
                which = np.flatnonzero(rare[i])
                to[:, which] = self.further(state[:, which], letters[i, which], roots[:, None])
            after[i] = to
            state = to & (MISS - 1)
        passed = np.cumsum(after >> 30, axis=0, dtype=np.int16)
        after &= MISS - 1
        ended, end = passed[-1].astype(np.int64), after[-1].copy()

        # again from where the one before ends; what then ends otherwise sends the next one through once more
        lang, seg = np.nonzero(np.broadcast_to(goes_on, state.shape))
        while len(seg):
            state, count, at, left = end[lang, seg - 1], np.zeros(len(seg), np.int64), np.full(len(seg), -1), np.arange(len(seg))
            for i in range(SEGMENT):
                a, b = lang[left], seg[left]
                to = self.steps[state[left] + columns[i, b]]
                if some[i]:
                    which = np.flatnonzero(rare[i, b])
                    to[which] = self.further(state[left[which]], letters[i, b[which]], roots[a[which]])
                state[left] = to & (MISS - 1)
                count[left] += to >> 30
                same = state[left] == after[i, a, b]
                at[left[same]] = i
                left = left[~same]
                if not len(left):
                    break
            met = at >= 0
            ended[lang, seg] = count + np.where(met, passed[-1, lang, seg] - passed[at, lang, seg], 0)
            to = np.where(met, after[-1, lang, seg], state)
            moved = to != end[lang, seg]
            end[lang, seg] = to
            moved &= np.append(goes_on[1:], False)[seg]
            lang, seg = lang[moved], seg[moved] + 1
        return np.add.reduceat(ended, last - pieces + 1, axis=1), end[:, last]

    def phrases(self, texts: list):
        """Phrases of each symbol array (none empty) by language."""
        import numpy as np

        whole = np.ones((len(self.roots), len(texts)), np.int64)
        lots: list[list[int]] = [[]]
        held = 0
        for k, t in enumerate(texts):
            if lots[-1] and held + len(t) > LOT:
                lots.append([])
                held = 0
            lots[-1].append(k)
            held += len(t)
        for at in range(0, len(self.roots), SIDE):
            roots = np.array(self.roots[at : at + SIDE], np.int32)
            for lot in lots:
                state = np.repeat(roots[:, None], len(lot), axis=1)
                # a lot is texts that fit together, or one text, parsed part by part
                for part in range(0, max(len(texts[k]) for k in lot), LOT):
                    ended, state = self._parsed([texts[k][part : part + LOT] for k in lot], state, roots)
                    whole[at : at + SIDE, lot] += ended
        return whole

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        import numpy as np

        if not hasattr(self, "table"):
            self.table = letter_table(self.letters)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        read = [symbols(t or "", self.table) for t in texts]
        known = [i for i, s in enumerate(read) if self.languages and s.any()]
        if known:
            counts = self.phrases([read[i] for i in known])
            rates = counts / np.array([len(read[i]) for i in known])
            odds = np.exp2(-64 * (rates - rates.min(axis=0)))
            share = odds.max(axis=0) / odds.sum(axis=0)
            for i, best, score in zip(known, counts.argmin(axis=0).tolist(), share.tolist(), strict=True):
                out[i] = self.languages[best], score
        return out


def sampled(docs: DataFrame) -> dict[str, list[str]]:
    """By language, the texts to learn from: whole ones, of labelled rows that aren't held out, in the order of a hash, until they have LETTERS together.

    At most one row comes of each of TEXTS slots, and of a slot one that isn't longer than LETTERS, if it has any; a
    language of longer texts alone is learned from the shortest one. Repeated rows count once.
    """
    row = F.xxhash64("doc_id", "text")
    size = F.char_length("text")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text", row.alias("row"), size.alias("size"))
    order = F.struct((F.col("size") > LETTERS).alias("long"), F.when(F.col("size") > LETTERS, F.col("size")).otherwise(F.xxhash64("row", F.lit(1))).alias("h"), "row", "size")
    slots = usable.groupBy("lang", F.pmod(F.xxhash64("row"), F.lit(TEXTS)).alias("slot")).agg(F.min(order).alias("x")).select("lang", "x.*").collect()  # at most TEXTS a language
    chosen: dict[str, list[int]] = {}
    letters: dict[str, int] = {}
    for r in sorted(slots, key=lambda r: (r.long, r.h, r.row)):
        if letters.get(r.lang, 0) < LETTERS and not (r.long and r.lang in chosen):
            chosen.setdefault(r.lang, []).append(r.row)
            letters[r.lang] = letters.get(r.lang, 0) + r.size
    asked = sorted({x for rows in chosen.values() for x in rows})
    rows = {(r.lang, r.row): r.text for r in usable.filter(F.col("row").isin(asked)).groupBy("lang", "row").agg(F.min("text").alias("text")).collect()} if asked else {}
    return {lang: [rows[lang, x] for x in rows_] for lang, rows_ in sorted(chosen.items())}


def learned(docs: DataFrame) -> Model:
    """The automata of what sampled() gives."""
    return Model(sampled(docs))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from the rows that aren't held out."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs.select("doc_id", "text", "lang")))

    def run(batches):
        for cols in batches:
            found = model.value.predict(cols["text"])
            yield {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")
