"""The suffix automaton of one or more sequences of small integers: its paths spell exactly their substrings."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    def __init__(self, sequences: Iterable[Iterable[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for symbol in s:
                last = self._extend(last, symbol)

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(steps)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """Part the class of q at the string that p and symbol spell."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        made, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = made
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return made
