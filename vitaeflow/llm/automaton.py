"""Regular expressions over bytes as deterministic automata.

Patterns are parsed into a small syntax tree, turned into a nondeterministic
automaton, determinised by subset construction and minimised by refining a
partition of the states. Supported: bytes, ``\\xHH`` and escaped bytes, classes
with ranges and negation, groups, ``|``, ``? * + {m} {m,} {m,n}``. There are no
anchors, captures or lazy repeats.
"""

from dataclasses import dataclass

import numpy as np

# --- syntax tree: ("set", frozenset of bytes) | ("cat", [..]) | ("alt", [..]) | ("rep", node, low, high or None)


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern.encode("latin-1"), 0, any_case

    def peek(self) -> bytes:
        return self.text[self.at : self.at + 1]

    def take(self) -> int:
        if self.at >= len(self.text):
            raise ValueError("the pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == b"|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() not in (b"", b"|", b")"):
            found.append(self.repeat(self.atom()))
        return found[0] if len(found) == 1 else ("cat", found)

    def repeat(self, node):
        while self.peek() in (b"?", b"*", b"+", b"{"):
            mark = self.take()
            if mark == ord("{"):
                end = self.text.index(b"}", self.at)
                low, comma, high = self.text[self.at : end].partition(b",")
                self.at = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                low, high = {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}[mark]
                node = ("rep", node, low, high)
        return node

    def atom(self):
        mark = self.take()
        if mark == ord("("):
            node = self.alternatives()
            if self.take() != ord(")"):
                raise ValueError("a group is not closed")
            return node
        if mark == ord("["):
            return ("set", self.cased(self.members()))
        if mark == ord("."):
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.cased({self.escaped() if mark == ord("\\") else mark}))

    def escaped(self) -> int:
        mark = self.take()
        if mark == ord("x"):
            digits = bytes((self.take(), self.take()))
            return int(digits, 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(mark, mark)

    def members(self) -> set[int]:
        negated = self.peek() == b"^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != b"]" or not found:
            low = self.take()
            low = self.escaped() if low == ord("\\") else low
            if self.peek() == b"-" and self.text[self.at + 1 : self.at + 2] != b"]":
                self.take()
                high = self.take()
                found |= set(range(low, (self.escaped() if high == ord("\\") else high) + 1))
            else:
                found.add(low)
        self.take()
        return set(range(256)) - found if negated else found

    def cased(self, members: set[int]) -> frozenset[int]:
        if self.any_case:
            members = members | {b ^ 32 for b in members if 65 <= b <= 90 or 97 <= b <= 122}
        return frozenset(members)


def parse(pattern: str, any_case: bool = False):
    parser = _Parser(pattern, any_case)
    node = parser.alternatives()
    if parser.at != len(parser.text):
        raise ValueError(f"unbalanced ) in {pattern!r}")
    return node


def mirrored(node):
    """The tree of the pattern read backwards."""
    kind = node[0]
    if kind == "cat":
        return ("cat", [mirrored(n) for n in reversed(node[1])])
    if kind == "alt":
        return ("alt", [mirrored(n) for n in node[1]])
    return ("rep", mirrored(node[1]), *node[2:]) if kind == "rep" else node


class _Nfa:
    """States with byte moves and free moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Add the tree after ``start``; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``next[state * width + class_of[byte]]``; state 0 is the start, ``accepts[state]`` a bit for each rule."""

    class_of: bytes
    width: int
    next: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def states(self) -> int:
        return len(self.accepts)


def _byte_classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Bytes that no move tells apart share a class; one byte for each class."""
    marks = [[] for _ in range(256)]
    for number, members in enumerate({m for moves in nfa.moves for m, _ in moves}):
        for b in members:
            marks[b].append(number)
    known: dict[tuple, int] = {}
    classes = bytes(known.setdefault(tuple(m), len(known)) for m in marks)
    return classes, [classes.index(c) for c in range(len(known))]


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart, by refining the partition until it holds."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        signature = np.column_stack([block, block[table]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    # the start's block becomes state 0
    order = np.argsort(np.where(np.arange(len(first)) == block[0], -1, np.arange(len(first))), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[block[table[first[order]]]], accepts[first[order]]


def compile_trees(trees: list, anywhere: bool) -> Automaton:
    """One automaton for all trees; rule ``i`` sets bit ``i``.

    ``anywhere``: a match may begin at any byte, and a state accepts if some match ends there.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = []
    for tree in trees:
        first = nfa.state()
        nfa.free[start].append(first)
        ends.append(nfa.add(tree, first))
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))
    class_of, samples = _byte_classes(nfa)
    first = nfa.closure([start])
    number, todo, table = {first: 0}, [first], []
    while todo:
        subset = todo.pop(0)
        row = []
        for b in samples:
            reached = nfa.closure({nxt for s in subset for members, nxt in nfa.moves[s] if b in members})
            if reached not in number:
                number[reached] = len(number)
                todo.append(reached)
            row.append(number[reached])
        table.append(row)
    accepts = np.zeros(len(number), np.int64)
    for subset, state in number.items():
        accepts[state] = sum(1 << i for i, end in enumerate(ends) if end in subset)
    small, marks = _minimal(np.array(table, np.int64), accepts)
    dead = [s for s in range(len(marks)) if not marks[s] and (small[s] == s).all()]
    return Automaton(class_of, len(samples), small.ravel(), marks, dead[0] if dead else -1)


def longest(automaton: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``; -1 if there is none."""
    steps, accepts, class_of, width, dead = automaton.next, automaton.accepts, automaton.class_of, automaton.width, automaton.dead
    state, end = 0, at if accepts[0] else -1
    for i in range(at, len(data)):
        state = steps[state * width + class_of[data[i]]]
        if state == dead:
            break
        if accepts[state]:
            end = i + 1
    return end
