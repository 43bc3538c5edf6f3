"""Regexes over bytes, compiled together into one minimal automaton.

The regex subset: literals, ``\\xHH`` and escaped punctuation, classes with
ranges, groups, ``|``, ``? * + {m} {m,} {m,n}`` and ``(?i:...)``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Nfa:
    """Thompson construction; each rule has its own final state."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return frozenset(found)


def parse(pattern: str):
    """Tree of ('set', bytes) | ('seq', items) | ('alt', items) | ('rep', item, least, most)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c != "x":
            return ord(c)
        at += 2
        return int(pattern[at - 2 : at], 16)

    def fold(values: Iterable[int], either: bool) -> frozenset[int]:
        out = set(values)
        if either:
            out |= {ord(chr(v).swapcase()) for v in out if v < 128 and chr(v).isalpha()}
        return frozenset(out)

    def one(either: bool):
        nonlocal at
        if pattern.startswith("(?i:", at):
            at += 4
            item = alternatives(True)
            at += 1
        elif pattern[at] == "(":
            at += 1
            item = alternatives(either)
            at += 1
        elif pattern[at] == "[":
            at += 1
            values: set[int] = set()
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                values.update(range(low, high + 1))
            at += 1
            item = ("set", fold(values, either))
        else:
            item = ("set", fold([char()], either))
        while at < len(pattern) and pattern[at] in "?*+{":
            sign = pattern[at]
            at += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, 0))
            if sign == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                least = int(low)
                most = least if not comma else int(high) if high else None
                at = end + 1
            item = ("rep", item, least, most)
        return item

    def alternatives(either: bool):
        nonlocal at
        choices = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                choices.append([])
            else:
                choices[-1].append(one(either))
        return ("alt", [("seq", c) for c in choices])

    return alternatives(False)


def build(nfa: Nfa, tree, start: int, back: bool = False) -> int:
    """Add the tree behind ``start`` (mirrored if ``back``); its end state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "seq":
        for item in reversed(tree[1]) if back else tree[1]:
            start = build(nfa, item, start, back)
        return start
    if kind == "alt":
        end = nfa.state()
        for item in tree[1]:
            nfa.empty[build(nfa, item, start, back)].append(end)
        return end
    _, item, least, most = tree
    for _ in range(least):
        start = build(nfa, item, start, back)
    if most is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[build(nfa, item, loop, back)].append(loop)
        return loop
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(most - least):
        start = build(nfa, item, start, back)
        nfa.empty[start].append(end)
    return end


class Automaton:
    """Minimal deterministic automaton of several rules.

    ``table[state, byte class]`` is the next state, ``of_byte`` the class of a
    byte, ``accepts[state]`` the bits of the rules that end in the state.
    States are numbered so that accepting ones come last (from ``first``).
    """

    def __init__(self, patterns: list[str], anywhere: bool = True, back: bool = False):
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for k, p in enumerate(patterns):
            own = nfa.state()
            nfa.empty[start].append(own)
            ends[build(nfa, parse(p), own, back)] = k
        sets = {s for moves in nfa.moves for s, _ in moves}
        marks = [tuple(b in s for s in sets) for b in range(256)]
        classes = {m: k for k, m in enumerate(dict.fromkeys(marks))}
        self.of_byte = np.array([classes[m] for m in marks], np.uint8)
        sample = [marks.index(m) for m in classes]
        root = nfa.closure([start])
        number, rows, todo = {root: 0}, [], [root]
        for here in todo:  # grows while it runs
            row = []
            for byte in sample:
                to = {n for s in here for chars, n in nfa.moves[s] if byte in chars}
                target = nfa.closure(to | ({start} if anywhere else set()))
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                row.append(number[target])
            rows.append(row)
        accepts = np.array([sum(1 << ends[s] for s in here if s in ends) for here in todo], np.int64)
        self.built = len(rows)
        self._minimise(np.array(rows, np.int64), accepts)

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, sample = np.unique(block, return_index=True)
        accepts = accepts[sample]
        order = np.argsort(accepts != 0, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.start = int(place[block[0]])
        self.table = place[block[table[sample]]][order]
        self.accepts = accepts[order]
        self.first = int((self.accepts == 0).sum())
