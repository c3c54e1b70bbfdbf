"""Generalised suffix automaton: every substring of many sequences of integers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """States are sets of substrings with the same ends; state 0 is the empty string.

    ``length[s]`` is the longest string of a state, ``link[s]`` the state of its longest
    suffix that lies in another state. Sequences are added one after the other; the state
    of a prefix that was added keeps that prefix as its longest string.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, sequence: Iterable[int]) -> int:
        """Adds all substrings of a sequence; the state of the whole sequence."""
        state = 0
        for symbol in sequence:
            state = self._step(state, symbol)
        return state

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _target(self, state: int, symbol: int) -> int:
        """Where the symbol leads, split off if that state also holds longer strings."""
        there = self.next[state][symbol]
        if self.length[there] == self.length[state] + 1:
            return there
        part = self._new(self.length[state] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = part
        while state != -1 and self.next[state].get(symbol) == there:
            self.next[state][symbol] = part
            state = self.link[state]
        return part

    def _step(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._target(last, symbol)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state != -1:
            self.link[new] = self._target(state, symbol)
        return new

    def move(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest match that ends with this further symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], matched + 1
        return 0, 0

    def at_length(self, state: int, length: int) -> int:
        """The state of the suffix of that length of a state's strings."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def nearest(self, marked: Sequence[bool]) -> list[int]:
        """For each state the first marked one along its links, itself included; -1 if none."""
        out = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            if marked[state]:
                out[state] = state
            elif self.link[state] >= 0:
                out[state] = out[self.link[state]]
        return out
