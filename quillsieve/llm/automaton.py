"""Generalised suffix automaton over integer tokens, with what each state knows of its occurrences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the added sequences.

    State 0 is the root. `length` is a state's longest string, `link` its suffix link. After
    `finish()`, `first[s]` is the smallest mark of any end position of state s's strings, and
    `owners[s]` maps a sequence's owner to the smallest end position in that sequence.
    """

    def __init__(self, keep_owners: bool = False) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.first: list = [None]
        self.owners: list[dict[int, int] | None] = [None]
        self.keep_owners = keep_owners

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        self.owners.append(None)
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A copy of q that holds only its strings of up to length[p] + 1 tokens."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: Sequence[int], marks: Iterable | None = None, owner: int = 0) -> None:
        """Add one sequence. marks: for each token, what `first` compares (smaller is earlier)."""
        last, nexts, link, length = 0, self.next, self.link, self.length
        marks = range(len(tokens)) if marks is None else marks
        for at, (token, mark) in enumerate(zip(tokens, marks, strict=True)):
            q = nexts[last].get(token)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, token)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p != -1 and token not in nexts[p]:
                    nexts[p][token] = new
                    p = link[p]
                if p != -1:
                    q = nexts[p][token]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, token)
                last = new
            if self.first[last] is None or mark < self.first[last]:
                self.first[last] = mark
            if self.keep_owners:
                self.owners[last] = self.owners[last] or {}
                self.owners[last].setdefault(owner, at)

    def finish(self) -> SuffixAutomaton:
        """Carry marks and owners to the states of shorter strings."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            p = self.link[s]
            if p > 0:
                if self.first[s] is not None and (self.first[p] is None or self.first[s] < self.first[p]):
                    self.first[p] = self.first[s]
                if self.keep_owners and self.owners[s]:
                    mine = self.owners[p] = self.owners[p] or {}
                    for owner, at in self.owners[s].items():
                        if owner not in mine or at < mine[owner]:
                            mine[owner] = at
        return self

    def matches(self, tokens: Iterable[int]) -> Iterable[tuple[int, int]]:
        """Matching statistics: for each token, the state and length of the longest match that ends there."""
        state, size, nexts, link, length = 0, 0, self.next, self.link, self.length
        for token in tokens:
            q = nexts[state].get(token)
            while q is None and state:
                state = link[state]
                size = length[state]
                q = nexts[state].get(token)
            if q is None:
                size = 0
            else:
                state, size = q, size + 1
            yield state, size

    def at_least(self, state: int, size: int) -> int:
        """The state of the last `size` tokens of a match in `state`."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state
