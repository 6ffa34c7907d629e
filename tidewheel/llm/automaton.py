"""Regular expressions compiled into one minimal deterministic automaton over bytes.

Supports literals, \\xHH and escaped characters, classes, groups, `|`, `*`, `+`, `?` and {m}, {m,}, {m,n}.
All rules run in one pass: the start state is part of every subset, so a state knows every rule that may
end at the byte just read. `backwards` compiles the rules' mirror images, whose ends, read from the right,
are the places where a match of a rule starts; `anchored` automata match from one place on and give the end.

A pass cuts the bytes into lanes of LANE bytes that step through the transition array side by side. A lane
in the middle of a text guesses that it begins in the start state. Where the lane before ends in another
state, the lane is run again from that one until it meets the states that it had, so the result is that of
one run over the whole text and no step is as long as a text.
"""

from __future__ import annotations

import numpy as np

LANE = 512


class _Parser:
    """Thompson construction: `moves` are (state, byte set, state), `free` empty moves."""

    def __init__(self, backwards: bool = False):
        self.backwards = backwards
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def rule(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        node = self.either()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} in {text!r}")
        start = self.state()
        return start, self.lay(node, start)

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.series()]
        while self.peek() == "|":
            self.take()
            options.append(self.series())
        return ("or", options)

    def series(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            out.append(self.repeat(self.atom()))
        return ("then", out)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.either()
            if self.take() != ")":
                raise ValueError("unclosed group")
            return node
        if c == "[":
            found: set[int] = set()
            other = self.peek() == "^"
            self.at += other
            while self.peek() != "]":
                low = self.char(self.take())
                high = low
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.char(self.take())
                found |= set(range(low, high + 1))
            self.take()
            return ("set", frozenset(range(256)) - found if other else frozenset(found))
        return ("set", frozenset([self.char(c)]))

    def char(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if c == "n":
                return 10
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def repeat(self, node):
        while (c := self.peek()) and c in "*+?{":
            self.take()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (0, 0))
            if c == "{":
                inner = self.text[self.at : self.text.index("}", self.at)]
                self.at += len(inner) + 1
                a, comma, b = inner.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            node = ("times", node, low, high)
        return node

    def lay(self, node, at: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((node[1], end))
            return end
        if kind == "then":
            for x in reversed(node[1]) if self.backwards else node[1]:
                at = self.lay(x, at)
            return at
        if kind == "or":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.free[at].append(first)
                self.free[self.lay(x, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.lay(inner, at)
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.lay(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[at].append(end)
        for _ in range(high - low):
            at = self.lay(inner, at)
            self.free[at].append(end)
        return end


class Automaton:
    """`step[state * classes + kind[byte]]` is the next state, `accept[state]` a bit set of rules that end there.

    An anchored automaton has a state `dead` that nothing leaves.
    """

    def __init__(self, rules: list[str], backwards: bool = False, anchored: bool = False):
        self.backwards = backwards
        nfa = _Parser(backwards)
        ends = [nfa.rule(r) for r in rules]

        def closure(states):
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        start = closure(s for s, _ in ends)
        again = frozenset() if anchored else start
        sets = {s for m in nfa.moves for s, _ in m}
        marks = {b: tuple(b in s for s in sets) for b in range(256)}
        names = {m: i for i, m in enumerate(dict.fromkeys(marks.values()))}
        self.kind = np.array([names[marks[b]] for b in range(256)], np.int64)
        sample = [int(np.flatnonzero(self.kind == i)[0]) for i in range(len(names))]
        known, table, order = {start: 0}, [], [start]
        for subset in order:
            row = []
            for b in sample:
                nxt = closure({t for s in subset for m, t in nfa.moves[s] if b in m}) | again
                if nxt not in known:
                    known[nxt] = len(order)
                    order.append(nxt)
                row.append(known[nxt])
            table.append(row)
        accept = np.array([sum(1 << i for i, (_, e) in enumerate(ends) if e in s) for s in order], np.int64)
        step = np.array(table, np.int64)
        group = np.unique(accept, return_inverse=True)[1]
        while True:  # partition refinement: states of a group that differ in where they go part
            finer = np.unique(np.c_[group, group[step]], axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        head = np.array([np.flatnonzero(group == g)[0] for g in range(group.max() + 1)])
        self.start, self.classes = int(group[0]), len(sample)
        small = group[step[head]]
        self.accept = accept[head]
        self.step = small.astype(np.int32).ravel()
        stay = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (self.accept == 0))
        self.dead = int(stay[0]) if anchored and len(stay) else -1
        self.rows = [r.tolist() for r in small[:, self.kind]] if anchored else []

    def states(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The state after each byte of a run over each text, from the left or, backwards, from the right."""
        n = len(data)
        if self.backwards:
            return self._run(data[::-1], n - offsets[::-1])[::-1]
        return self._run(data, offsets)

    def _run(self, data, offsets):
        n = len(data)
        if not n:
            return np.zeros(0, np.int32)
        low, high = offsets[:-1], offsets[1:]
        lanes = -(-(high - low) // LANE)
        first = np.cumsum(lanes) - lanes  # number of each text's first lane
        own = np.repeat(np.arange(len(low)), lanes)
        nth = np.arange(len(own)) - first[own]
        a = low[own] + nth * LANE
        size = np.minimum(high[own] - a, LANE)
        kind = self.kind[data].astype(np.int32)
        out = np.empty(n, np.int32)
        order = np.argsort(-size, kind="stable")  # longest first: those still running are a prefix
        where, state = a[order], np.full(len(a), self.start, np.int32)
        running = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")
        for i, m in enumerate(running):
            at = where[:m] + i
            state[:m] = self.step[state[:m] * self.classes + kind[at]]
            out[at] = state[:m]
        # lanes whose guess was wrong, until none is left; only they and what they change are run again
        lane = np.flatnonzero(nth > 0)
        lane = lane[out[a[lane] - 1] != self.start]
        while len(lane):
            at, end, state = a[lane], a[lane] + size[lane], out[a[lane] - 1]
            changed = []
            while len(at):
                state = self.step[state * self.classes + kind[at]]
                differs = out[at] != state
                at, end, state, lane = at[differs], end[differs], state[differs], lane[differs]
                out[at] = state
                at = at + 1
                done = at == end
                changed.append(lane[done])
                at, end, state, lane = at[~done], end[~done], state[~done], lane[~done]
            lane = np.concatenate(changed) + 1  # their ends changed, so those after them begin elsewhere
            lane = lane[lane < len(a)]
            lane = lane[nth[lane] > 0]
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(place, rules) of the bytes at which a match ends (backwards: starts), in order."""
        got = self.accept[self.states(data, offsets)]
        at = np.flatnonzero(got)
        return np.stack([at, got[at]], axis=1)

    def longest(self, raw: bytes, at: int, end: int) -> int:
        """The end of the longest match of an anchored automaton from `at` on; -1 where there is none."""
        state, best, rows, accept, dead = self.start, -1, self.rows, self.accept, self.dead
        while at < end and state != dead:
            state = rows[state][raw[at]]
            at += 1
            if accept[state]:
                best = at
        return best
