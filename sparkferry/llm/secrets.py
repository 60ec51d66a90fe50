"""Secret scans by one combined deterministic automaton.

All rules' regular expressions are compiled on the driver: to one nondeterministic automaton over bytes, by subset
construction to a deterministic one that searches for all of them at once, and by partition refinement to the smallest
such; it is a transition array. A text's bytes pass through it once. Where a rule's matches end, that rule's reversed
automaton runs back to the leftmost start. The map over rows shuffles nothing, and the array's size depends on the rules only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import carried, ship, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern: literals, classes, groups, |, *, +, ?, {m,} and {m,n}; matches are leftmost and longest, and
    don't overlap within a kind. head: with least, the match's rest after the longest match of head has at least so many
    bytes; without head the whole match has. Failing matches are dropped, but they have taken their place.
    Two matches of one pattern that end at different places must not lie one within the other."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0
    any_case: bool = False


_KEYS = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The first three are the asked-for base, the others are this method's own. A run of hexadecimal digits, of which texts are
#: full, has its least length in the pattern: a shorter run can't hide a longer one.
#: Every rule's matches grow byte by byte: where one ends, no longer one begins behind a gap, so ends of the one pass are spans' ends. (A private
#: key's END line would break that; it holds no secret and stays.)
RULES = (
    Rule("assign", _KEYS + r"[A-Za-z0-9+/_.=-]+", _KEYS, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", "", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x0a\x0d]*"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", "", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", "", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "", 40),
)
BASE = ("assign", "access", "hex")


class _Parser:
    """A regular expression as a tree: ("set", bytes), ("cat", parts), ("or", parts), ("star", part), ("opt", part)."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.at, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.either()
        if self.at != len(self.p):
            raise ValueError(f"unexpected {self.p[self.at]!r} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, x):
        while self.peek() and self.peek() in "*+?{":
            c = self.take()
            if c == "*":
                x = ("star", x)
            elif c == "+":
                x = ("cat", [x, ("star", x)])
            elif c == "?":
                x = ("opt", x)
            else:
                end = self.p.index("}", self.at)
                low, comma, high = self.p[self.at : end].partition(",")
                self.at = end + 1
                rest = [("star", x)] if comma and not high else [("opt", x)] * (int(high or low) - int(low))
                x = ("cat", [x] * int(low) + rest)
        return x

    def atom(self):
        c = self.take()
        if c == "(":
            tree = self.either()
            if self.peek() != ")":
                raise ValueError(f"open group in {self.p!r}")
            self.at += 1
            return tree
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", self.cased({self.escaped()}))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.cased({ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def members(self) -> frozenset[int]:
        if self.peek() == "^":
            self.at += 1
            return frozenset(range(256)) - self.members()
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                c = self.take()
                found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        return self.cased(found)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).parse()


def reverse(tree):
    kind, x = tree
    if kind == "cat":
        return (kind, [reverse(p) for p in reversed(x)])
    if kind == "or":
        return (kind, [reverse(p) for p in x])
    return (kind, x if kind == "set" else reverse(x))


class NFA:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Adds a tree from a state; its end state."""
        kind, x = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((x, end))
        elif kind == "cat":
            end = start
            for p in x:
                end = self.add(p, end)
        elif kind == "or":
            end = self.state()
            for p in x:
                self.empty[start].append(first := self.state())
                self.empty[self.add(p, first)].append(end)
        elif kind == "opt":
            self.empty[start].append(first := self.state())
            end = self.state()
            self.empty[start].append(end)
            self.empty[self.add(x, first)].append(end)
        else:
            hub = self.state()
            self.empty[start].append(hub)
            self.empty[hub].append(first := self.state())
            self.empty[self.add(x, first)].append(hub)
            end = self.state()
            self.empty[hub].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class DFA:
    """letters has each byte's letter: bytes that no class tells apart are one letter. table[width * state + letter] is
    width * the next state. States from `accepts` on accept; masks has their rules' bits. `dead`: no way to accept, or -1."""

    letters: bytes
    width: int
    table: np.ndarray
    start: int
    accepts: int
    masks: tuple[int, ...]
    dead: int


def compile_dfa(trees: list, search: bool) -> DFA:
    """The smallest automaton of the trees, tree k having bit k; with `search` it finds them anywhere."""
    nfa = NFA()
    first = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        nfa.empty[first].append(s := nfa.state())
        ends[nfa.add(tree, s)] = 1 << k
    groups = np.zeros(256, np.int64)
    for sets in {x for m in nfa.moves for x, _ in m}:
        mark = np.isin(np.arange(256), list(sets))
        groups = np.unique(groups * 2 + mark, return_inverse=True)[1]
    letters = [int(np.flatnonzero(groups == g)[0]) for g in range(int(groups.max()) + 1)]
    # Sets of states are integers' bits; only states that move or end a rule tell sets apart.
    counts = [s for s in range(len(nfa.moves)) if nfa.moves[s] or s in ends]
    bit = {s: 1 << k for k, s in enumerate(counts)}
    reach = functools.cache(lambda s: sum(bit[t] for t in nfa.closure({s}) if t in bit))
    steps = []
    for s in counts:
        to = [0] * len(letters)
        for x, t in nfa.moves[s]:
            for k, b in enumerate(letters):
                if b in x:
                    to[k] |= reach(t)
        steps.append([(k, m) for k, m in enumerate(to) if m])
    begin = reach(first)
    found, rows, todo = {begin: 0}, [], [begin]
    for now in todo:
        row = [begin if search else 0] * len(letters)
        left = now
        while left:
            low = left & -left
            for k, m in steps[low.bit_length() - 1]:
                row[k] |= m
            left ^= low
        for to in row:
            if to not in found:
                found[to] = len(todo)
                todo.append(to)
        rows.append([found[to] for to in row])
    moves = np.array(rows, np.int64)
    mask = np.array([sum({e for s, e in ends.items() if state & bit[s]}) for state in todo], np.int64)
    # Refinement until no letter tells two states of a class apart.
    part = np.unique(mask, return_inverse=True)[1]
    while True:
        key = np.column_stack([part, part[moves]])
        new = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == part.max():
            break
        part = new
    n = int(part.max()) + 1
    one = np.zeros(n, np.int64)
    one[part] = np.arange(len(part))  # a state of each class
    small, marks = part[moves[one]], mask[one]
    order = np.argsort(marks != 0, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    table, marks, w = place[small][order], marks[order], len(letters)
    alone = [s for s in range(n) if not marks[s] and (table[s] == s).all()]
    return DFA(bytes(groups.tolist()), w, (table * w).reshape(-1).astype(np.int32), int(place[part[0]]) * w, w * int((marks == 0).sum()), tuple(int(m) for m in marks), w * alone[0] if alone and not search else -1)


class Scanner:
    """All rules' automata; picklable, and compiled once for each tuple of rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern, r.any_case) for r in rules]
        self.all = compile_dfa(trees, True)
        self.back = [compile_dfa([reverse(t)], False) for t in trees]
        self.heads = [compile_dfa([parse(r.head, r.any_case)], False) if r.head else None for r in rules]
        self.lists = None

    def __getstate__(self):
        return self.__dict__ | {"lists": None}

    def ready(self) -> Scanner:
        if self.lists is None:
            whole = list(range(0, len(self.all.table) + 1))  # one object for each state
            self.lists = ([whole[s] for s in self.all.table.tolist()], [d.table.tolist() for d in self.back], [d and d.table.tolist() for d in self.heads])
        return self

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(index, state) of each byte at which some match ends: the one pass."""
        table, accepts, s, out = self.lists[0], self.all.accepts, self.all.start, []
        for i, letter in enumerate(data.translate(self.all.letters)):
            s = table[s + letter]
            if s >= accepts:
                out.append((i, s))
        return out

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        found = []
        if not (hits := self.ready().hits(data)):
            return found
        for k, rule in enumerate(self.rules):
            bit, free = 1 << k, 0
            ends = [i for i, s in hits if self.all.masks[s // self.all.width] & bit]
            for i, after in zip(ends, [*ends[1:], -1], strict=False):
                if after == i + 1:
                    continue  # the match goes on
                start = self.first(k, data, free, i + 1)
                if start is None:
                    continue
                free = i + 1
                if free - self.head_end(k, data, start, free) >= rule.least:
                    found.append((start, k, free))
        return sorted(found)

    def first(self, k: int, data: bytes, free: int, end: int) -> int | None:
        """The leftmost start, from `free` on, of a match of rule k that ends there."""
        dfa, table = self.back[k], self.lists[1][k]
        s, best = dfa.start, None
        for i in range(end - 1, free - 1, -1):
            s = table[s + dfa.letters[data[i]]]
            if s >= dfa.accepts:
                best = i
            elif s == dfa.dead:
                break
        return best

    def head_end(self, k: int, data: bytes, start: int, end: int) -> int:
        """Where the longest match of a rule's head ends; the start without one."""
        dfa = self.heads[k]
        if dfa is None:
            return start
        table, s, best = self.lists[2][k], dfa.start, start
        for i in range(start, end):
            s = table[s + dfa.letters[data[i]]]
            if s >= dfa.accepts:
                best = i + 1
            elif s == dfa.dead:
                break
        return best


@functools.cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def spans_of(found: Scanner, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text in code points, by start, then kind as listed."""
    data = text.encode()
    got = found.scan(data)
    if got and len(data) != len(text):
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # up to and with each byte
        place = lambda b: int(points[b - 1]) if b else 0
        got = [(place(s), k, place(e)) for s, k, e in got]
    return [(found.rules[k].kind, s, e) for s, k, e in got]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each secret, or stretch of overlapping ones, replaced by `[kind]` of the first."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, redacted: bool = False, prefix: str = "") -> DataFrame:
    """Each row's kept columns with spans (kind, start and end in code points), and with `redacted` the text without them.

    Whole texts are scanned. A null text has no spans (and stays null); repeated rows stay; an empty table gives an empty
    one; other columns may have any name. prefix: goes before the results' names.
    """
    ship(df.sparkSession)
    rows, kept, back = carried(df, text, keep, (f"{prefix}spans", f"{prefix}redacted"))
    made = T._parse_datatype_string(f"spans {SPANS}" + ", redacted string" * redacted)
    schema = T.StructType(kept + made.fields)
    found = scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "in__"):
                texts = batch.column("in__").to_pylist()
                spans = [spans_of(found, s) if s else [] for s in texts]
                new = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], kind)]
                if redacted:
                    new.append(pa.array([s if not x else redact(s, x) for s, x in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*back, *[F.col(c).alias(prefix + c) for c in made.names])
