"""Regular expressions over bytes as one minimal deterministic automaton, and a lockstep scan of many texts.

``compile_rules`` parses each expression, joins their nondeterministic automata under one start, determinises by subset
construction and minimises by partition refinement. The result is a pair of arrays, so it is sent to workers as data.

Compiled ``backward`` and run from the last byte to the first, the automaton accepts at a byte where a match begins. Texts
are cut into lanes that advance together, long texts into many. A lane starts some bytes before its own, in the state
that most starts lead to; where the lane before it ends in another state after all, it runs again from that one, until
all lanes agree. So the result is that of one pass over each whole text, however the text was cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """Literals, ``.``, classes, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``; escapes of one byte and \\xHH."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern.encode("latin-1"), 0

    def peek(self) -> int | None:
        return self.p[self.i] if self.i < len(self.p) else None

    def take(self) -> int:
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        tree = self.either()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {chr(self.p[self.i])!r} at {self.i}")
        return tree

    def either(self):
        options = [self.sequence()]
        while self.peek() == ord("|"):
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() is not None and self.peek() not in b"|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        part = self.atom()
        while (c := self.peek()) is not None and c in b"?*+{":
            self.take()
            if c == ord("{"):
                end = self.p.index(b"}", self.i)
                low, comma, high = self.p[self.i : end].decode().partition(",")
                self.i = end + 1
                part = ("rep", part, int(low), (int(high) if high else None) if comma else int(low))
            else:
                part = ("rep", part, *{ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}[c])
        return part

    def escaped(self) -> int:
        if self.peek() == ord("x"):
            self.take()
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return self.take()

    def atom(self):
        c = self.take()
        if c == ord("("):
            tree = self.either()
            if self.peek() != ord(")"):
                raise ValueError("missing )")
            self.take()
            return tree
        if c == ord("["):
            return ("set", self.members())
        if c == ord("."):
            return ("set", ANY - {10})
        return ("set", frozenset({self.escaped() if c == ord("\\") else c}))

    def members(self) -> frozenset[int]:
        negated = self.peek() == ord("^")
        if negated:
            self.take()
        out: set[int] = set()
        first = True
        while first or self.peek() != ord("]"):
            first = False
            a = self.take()
            a = self.escaped() if a == ord("\\") else a
            if self.peek() == ord("-") and self.p[self.i + 1] != ord("]"):
                self.take()
                b = self.take()
                b = self.escaped() if b == ord("\\") else b
                out.update(range(a, b + 1))
            else:
                out.add(a)
        self.take()
        return frozenset(ANY - out if negated else out)


class _Nfa:
    def __init__(self):
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, tree, at: int) -> int:
        """Append ``tree`` after state ``at``; returns the state reached."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            self.on[at].append((tree[1], to))
            return to
        if kind == "seq":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if kind == "or":
            to = self.state()
            for part in tree[1]:
                self.free[self.add(part, at)].append(to)
            return to
        _, part, low, high = tree
        for _ in range(low):
            at = self.add(part, at)
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        ends = [at]
        for _ in range(high - low):
            at = self.add(part, at)
            ends.append(at)
        to = self.state()
        for x in ends:
            self.free[x].append(to)
        return to

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``step[state * n_classes + byte_class[byte]]`` is the next state times ``n_classes``; states from
    ``first_hit`` on accept the rules in the bits of ``accepts[state]``. State 0 is the start; ``dead`` leads nowhere else."""

    byte_class: np.ndarray
    step: np.ndarray
    n_classes: int
    first_hit: int
    accepts: np.ndarray
    dead: int

    def longest(self, text: bytes, start: int) -> int:
        """End of the longest match that begins at ``start`` (an anchored automaton), -1 without one."""
        step, classes, limit, dead = self._lists()
        state, end = 0, -1
        for at in range(start, len(text)):
            state = step[state + classes[text[at]]]
            if state >= limit:
                end = at + 1
            elif state == dead:
                break
        return end

    def _lists(self) -> tuple[list[int], list[int], int, int]:
        if "lists" not in self.__dict__:
            self.__dict__["lists"] = (self.step.tolist(), self.byte_class.tolist(), self.first_hit * self.n_classes, self.dead * self.n_classes)
        return self.__dict__["lists"]

    def starts(self, texts: list[bytes], lane: int = 4096, warm: int = 64, together: int = 2048) -> dict[int, list[tuple[int, int]]]:
        """For a backward automaton: {text: [(byte, bits of the rules that match from there), ...]}, bytes ascending."""
        lanes = [(t, lo, min(lo + lane, len(x))) for t, x in enumerate(texts) for lo in range(0, len(x), lane)]
        found: list[list[tuple[int, int]]] = [[] for _ in lanes]
        last = np.zeros(len(lanes), np.int32)
        # lane k + 1 of a text comes before lane k on the way back
        follows = np.array([k + 1 < len(lanes) and lanes[k + 1][0] == lanes[k][0] for k in range(len(lanes))], bool)
        entry = np.full(len(lanes), -1, np.int32)
        todo = list(range(len(lanes)))
        while todo:
            todo.sort(key=lambda k: lanes[k][2] - lanes[k][1])
            for at in range(0, len(todo), together):
                self._run(texts, lanes, todo[at : at + together], entry, found, last, warm)
            wrong = np.flatnonzero(follows[:-1] & (entry[:-1] != last[1:])) if len(lanes) > 1 else np.zeros(0, int)
            entry[wrong] = last[wrong + 1]
            todo = wrong.tolist()
        out: dict[int, list[tuple[int, int]]] = {}
        for k, hits in enumerate(found):
            if hits:
                out.setdefault(lanes[k][0], []).extend(reversed(hits))
        return out

    def _run(self, texts, lanes, some, entry, found, last, warm) -> None:
        """Run some lanes back to front; a lane with no entry state yet gets one from ``warm`` bytes after its end."""
        pieces = {}
        for k in some:
            t, lo, hi = lanes[k]
            pieces[k] = texts[t][lo : hi + warm] if entry[k] < 0 and hi < len(texts[t]) else texts[t][lo:hi]
            found[k].clear()
        some = sorted(some, key=lambda k: len(pieces[k]))
        parts = [pieces[k] for k in some]
        wide = max(map(len, parts))
        grid = np.zeros((len(parts), wide), np.uint8)
        for row, x in enumerate(parts):
            grid[row, wide - len(x) :] = np.frombuffer(x, np.uint8)
        columns = np.ascontiguousarray(self.byte_class.astype(np.uint8)[grid].T)
        sizes = np.array([len(x) for x in parts])
        own = np.array([lanes[k][2] - lanes[k][1] for k in some])
        low = np.array([lanes[k][1] for k in some])
        known = np.array([entry[k] for k in some])
        now = np.where(known >= 0, known, 0).astype(np.int32)
        limit = self.first_hit * self.n_classes
        rows = np.arange(len(parts))
        turn = set((sizes - own).tolist())
        for back in range(wide):
            # lanes are sorted by length, so those that still run are the last ones
            if back in turn:
                ready = (sizes - own == back) & (known < 0)
                for r in rows[ready].tolist():
                    entry[some[r]] = now[r]
            live = int(np.searchsorted(sizes, back, side="right")) if back else 0
            now[live:] = self.step[now[live:] + columns[wide - 1 - back, live:]]
            if now.max() >= limit:
                for r in np.flatnonzero(now[live:] >= limit) + live:
                    place = sizes[r] - 1 - back
                    if place < own[r]:
                        found[some[r]].append((int(low[r] + place), int(self.accepts[now[r] // self.n_classes])))
        last[some] = now


def _turned(tree):
    """The tree of the reversed expression."""
    kind = tree[0]
    if kind == "seq":
        return ("seq", [_turned(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [_turned(x) for x in tree[1]])
    return tree if kind == "set" else ("rep", _turned(tree[1]), *tree[2:])


def compile_rules(patterns: list[str], *, backward: bool = False, anchored: bool = False) -> Automaton:
    """One automaton that finds each pattern anywhere in a text, or from its first byte on (``anchored``)."""
    nfa = _Nfa()
    start = nfa.state()
    final: dict[int, int] = {}
    for k, p in enumerate(patterns):
        begin = nfa.state()
        nfa.free[start].append(begin)
        tree = _Parser(p).parse()
        final[nfa.add(_turned(tree) if backward else tree, begin)] = 1 << k
    # bytes that no expression tells apart share a class
    sets = sorted({s for on in nfa.on for s, _ in on}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {sig: k for k, sig in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([kinds[s] for s in signature], np.int32)
    sample = [int(np.flatnonzero(byte_class == k)[0]) for k in range(len(kinds))]
    home = nfa.closure({start})
    number, todo, rows = {home: 0}, [home], []
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            to = nfa.closure({t for x in now for s, t in nfa.on[x] if b in s} | (set() if anchored else {start}))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    mask = np.array([sum({final[x] for x in s if x in final}) for s in number], np.int64)
    # partition refinement: states stay together while they accept alike and step into the same parts
    part = np.unique(mask, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    parts = int(part.max()) + 1
    first = np.array([int(np.flatnonzero(part == k)[0]) for k in range(parts)])
    # the start first, accepting states last
    rank = sorted(range(parts), key=lambda k: (mask[first[k]] != 0, k != part[0], first[k]))
    place = np.empty(parts, np.int64)
    place[rank] = np.arange(parts)
    chosen = first[rank]
    step = (place[part[table[chosen]]] * len(kinds)).astype(np.int32)
    accepts = mask[chosen]
    stuck = np.flatnonzero((step == np.arange(parts)[:, None] * len(kinds)).all(axis=1) & (accepts == 0)) if anchored else []
    return Automaton(byte_class, step.ravel(), len(kinds), int((accepts == 0).sum()), accepts, int(stuck[0]) if len(stuck) else -1)
