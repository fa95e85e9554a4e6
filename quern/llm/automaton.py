"""Regexes over bytes -> one minimal deterministic automaton in transition arrays.

The syntax covered: literals, escapes (also \\xNN), classes, groups, |, ?, *, + and {m}, {m,}, {m,n}. Expressions are
parsed to trees, trees become a nondeterministic automaton, subset construction makes that deterministic, and
partition refinement minimises it. Bytes that no expression tells apart share a column.
"""

from __future__ import annotations

import numpy as np

ALL = (1 << 256) - 1
_ESCAPED = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}
_SETS = {"d": "0-9", "w": "A-Za-z0-9_"}


class _Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def whole(self):
        tree = self.either()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} in {self.s!r}")
        return tree

    def either(self):
        options = [self.row()]
        while self.peek() == "|":
            self.take()
            options.append(self.row())
        return options[0] if len(options) == 1 else ("alt", options)

    def row(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.counted())
        return ("cat", items)

    def counted(self):
        item = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                bounds = (int(low), (int(high) if high else None) if comma else int(low))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            item = ("rep", item, *bounds)
        return item

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.either()
            if self.take() != ")":
                raise ValueError("missing )")
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", ALL & ~(1 << 10))
        if c == "\\":
            return ("set", self.escaped())
        return ("set", 1 << ord(c))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return 1 << int(self.s[self.i - 2 : self.i], 16)
        if c in _SETS:
            return _Parser(f"[{_SETS[c]}]").atom()[1]
        return 1 << _ESCAPED.get(c, ord(c))

    def members(self) -> int:
        negated, mask = self.peek() == "^", 0
        if negated:
            self.take()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else 1 << ord(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]" and low.bit_count() == 1:
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else 1 << ord(c)
                low = (high << 1) - low
            mask |= low
        return ALL & ~mask if negated else mask


def parse(regex: str):
    return _Parser(regex).whole()


def reverse(tree):
    """The tree of the reversed language."""
    if tree[0] == "cat":
        return ("cat", [reverse(t) for t in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(t) for t in tree[1]])
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Adds the tree from state `at`; returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((tree[1], end))
            return end
        if kind == "cat":
            for t in tree[1]:
                at = self.add(t, at)
            return at
        if kind == "alt":
            end = self.state()
            for t in tree[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.add(t, begin)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            at = self.add(item, at)
        if high is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(item, loop)].append(loop)
            return loop
        ends = [at]
        for _ in range(high - low):
            at = self.add(item, at)
            ends.append(at)
        end = self.state()
        for e in ends:
            self.empty[e].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal automaton: `column` of each byte, `step[state, column]`, `accepts[state]` as a bit for each expression.

    State 0 is the start. If it is made to search, expressions may begin at every place.
    """

    def __init__(self, trees: list, search: bool):
        nfa, ends = _Nfa(), {}
        root = nfa.state()
        for k, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[root].append(begin)
            ends[nfa.add(tree, begin)] = 1 << k
        masks = {m for moves in nfa.moves for m, _ in moves}
        groups: dict[tuple, list[int]] = {}
        for b in range(256):
            groups.setdefault(tuple(sorted(m for m in masks if m >> b & 1)), []).append(b)
        self.column = np.zeros(256, np.uint8)
        leads = []
        for c, members in enumerate(groups.values()):
            self.column[members] = c
            leads.append(members[0])
        start = nfa.closure([root])
        known, todo, rows, accepts = {start: 0}, [start], [], []
        for states in todo:
            moves = [m for s in states for m in nfa.moves[s]]
            row = []
            for b in leads:
                to = {t for m, t in moves if m >> b & 1}
                to = nfa.closure(to | {root} if search else to)
                if to not in known:
                    known[to] = len(todo)
                    todo.append(to)
                row.append(known[to])
            rows.append(row)
            accepts.append(sum({ends[s] for s in states if s in ends}))
        self._minimise(np.array(rows, np.int64), np.array(accepts, np.int64))

    def _minimise(self, step: np.ndarray, accepts: np.ndarray) -> None:
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            _, first, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_index=True, return_inverse=True)
            finer = finer.reshape(-1)
            if len(first) == block.max() + 1:
                break
            block = finer
        # blocks by their first state, so that the start is state 0
        order = np.argsort(np.argsort(first))
        lead = np.sort(first)
        self.step = order[finer][step[lead]].astype(np.int32)
        self.accepts = accepts[lead]

    def trace(self, columns: np.ndarray, width: int = 512) -> np.ndarray:
        """The state after each of the bytes, given as columns.

        The bytes are cut into lanes that advance together, each from state 0. A lane whose forerunner ended
        elsewhere is run again from there, until its states agree with those it has; so the result is that of a
        single pass, whatever the bytes.
        """
        n, c = len(columns), self.step.shape[1]
        width = max(1, min(width, n))
        lanes = -(-n // width)
        grid = np.zeros(lanes * width, np.int32)
        grid[:n] = columns
        grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
        flat = (self.step * c).reshape(-1)
        out = np.empty((width, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(width):
            state = flat.take(state + grid[t])
            out[t] = state
        begin, lane = np.zeros(lanes, np.int32), np.arange(1, lanes)
        while True:
            lane = lane[out[-1, lane - 1] != begin[lane]]
            if not len(lane):
                break
            begin[lane] = state = out[-1, lane - 1]
            going = lane
            for t in range(width):
                state = flat.take(state + grid[t, going])
                differs = state != out[t, going]
                going, state = going[differs], state[differs]
                if not len(going):
                    break
                out[t, going] = state
            lane = going[going + 1 < lanes] + 1  # their ends have changed
        return out.T.reshape(-1)[:n] // c
