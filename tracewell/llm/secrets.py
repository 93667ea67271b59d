"""Secret scans with one combined deterministic automaton (operator 7).

The rules' regular expressions become one automaton by subset construction over byte classes,
which is then minimised and stored as transition arrays. One pass over the bytes of a batch gives
the places where matches of each rule end; the pass steps many slices of the batch at once.

Spans come from these ends. The first end after what was matched before gives the leftmost match:
a rule's reversed automaton, from there back, finds its start, and the rule's own automaton, from the
start on, its longest form, which is the greedy one for these rules. Where an end belongs to a match
that began within the one before, a fresh scan takes over up to the next end. So every byte is read a
fixed number of times, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows


@dataclass(frozen=True)
class Rule:
    """head and body, one after the other, make the expression; the length of the body counts, with a
    least length. fold: ASCII letters in either case."""

    kind: str
    body: str
    head: str = ""
    least: int = 0
    fold: bool = False

    @property
    def shortest(self) -> str:
        """What the combined pass looks for: the shortest form of every match; of hex digits, one long enough."""
        body = f"{self.body[:-1]}{{{self.least}}}" if self.kind == "hex" else self.body.removesuffix("+")
        return self.head + body


#: The base rules.
BASE = [
    Rule("assign", "[A-Za-z0-9+/_.=-]+", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 12, True),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]+", least=16),
]
#: Rules that the base lacks.
MORE = [
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", least=24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url", "[a-z]+://[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+@[A-Za-z0-9.-]+"),
]
RULES = BASE + MORE
KINDS = [r.kind for r in RULES]


class Nfa:
    """Nondeterministic automaton of one expression: literals, \\x20, escapes, classes, groups, | ? * + {n}."""

    def __init__(self):
        self.on: list[list[tuple[frozenset[int], int]]] = []  # of each state: (bytes, next)
        self.free: list[list[int]] = []
        self.fold = False

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def parse(self, text: str, fold: bool = False) -> tuple[int, int]:
        self.text, self.at, self.fold = text, 0, fold
        start, end = self.choice()
        if self.at != len(text):
            raise ValueError(f"can't read {text[self.at:]!r}")
        return start, end

    def choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.chain()
            self.free[start].append(a)
            self.free[b].append(end)
            if self.text[self.at : self.at + 1] != "|":
                return start, end
            self.at += 1

    def chain(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            a, b = self.atom()
            stop, sign = self.at, self.text[self.at : self.at + 1]
            if sign == "{":
                close = self.text.index("}", stop)
                for _ in range(int(self.text[stop + 1 : close]) - 1):
                    self.at = begin
                    c, d = self.atom()
                    self.free[b].append(c)
                    b = d
                self.at = close + 1
            elif sign and sign in "?*+":
                self.at += 1
                out = self.state()
                self.free[b].append(out)
                if sign in "?*":
                    self.free[a].append(out)
                if sign in "*+":
                    self.free[b].append(a)
                b = out
            self.free[end].append(a)
            end = b
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            found = self.choice()
            self.at += 1
            return found
        if c == "[":
            self.at += 1
            chars: set[int] = set()
            while self.text[self.at] != "]":
                low = self.char()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    chars.update(range(low, self.char() + 1))
                else:
                    chars.add(low)
            self.at += 1
        else:
            chars = {self.char()}
        if self.fold:
            chars |= {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        start, end = self.state(), self.state()
        self.on[start].append((frozenset(chars), end))
        return start, end

    def reversed(self) -> Nfa:
        out = Nfa()
        for _ in self.on:
            out.state()
        for s, steps in enumerate(self.on):
            for chars, to in steps:
                out.on[to].append((chars, s))
            for to in self.free[s]:
                out.free[to].append(s)
        return out

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)


class Automaton:
    """classes[byte] and step[state, class]; ends[state]: a bit for each rule that ends there.

    loose: a match may begin at every byte; else only at the first. State 0 is the start."""

    def __init__(self, nfa: Nfa, root: int, final: dict[int, int], loose: bool = True):
        groups: dict[tuple, int] = {}
        sets = sorted({c for steps in nfa.on for c, _ in steps}, key=sorted)
        self.classes = np.array([groups.setdefault(tuple(b in s for s in sets), len(groups)) for b in range(256)], dtype=np.uint8)
        sample = [int(np.argmax(self.classes == k)) for k in range(len(groups))]
        self.step, self.ends = self._minimise(*self._subsets(nfa, root, final, sample, loose))
        self._rows, self._ends, self._class = self.step.tolist(), self.ends.tolist(), bytes(self.classes)
        dead = [s for s, row in enumerate(self._rows) if not self._ends[s] and all(t == s for t in row)]
        self.dead = dead[0] if dead and not loose else -1

    @staticmethod
    def of(rules: list[tuple[str, bool]]) -> Automaton:
        """All expressions as one."""
        nfa, final = Nfa(), {}
        root = nfa.state()
        for i, (text, fold) in enumerate(rules):
            start, end = nfa.parse(text, fold)
            nfa.free[root].append(start)
            final[end] = 1 << i
        return Automaton(nfa, root, final)

    @staticmethod
    def _subsets(nfa: Nfa, root: int, final: dict[int, int], sample: list[int], loose: bool) -> tuple[np.ndarray, np.ndarray]:
        closed: dict[int, frozenset[int]] = {}

        def closure(s: int) -> frozenset[int]:
            if s not in closed:
                seen, todo = {s}, [s]
                while todo:
                    for x in nfa.free[todo.pop()]:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                closed[s] = frozenset(x for x in seen if nfa.on[x] or x in final)
            return closed[s]

        first = closure(root)
        number, todo, step = {first: 0}, [first], []
        for now in todo:  # grows while it is read
            row = []
            for byte in sample:
                to = set(first) if loose else set()
                for s in now:
                    for chars, nxt in nfa.on[s]:
                        if byte in chars:
                            to |= closure(nxt)
                to = frozenset(to)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            step.append(row)
        ends = [0] * len(todo)
        for i, now in enumerate(todo):
            for s in now:
                ends[i] |= final.get(s, 0)
        return np.array(step, dtype=np.int64), np.array(ends, dtype=np.int64)

    @staticmethod
    def _minimise(step: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Splits blocks of states that behave alike until none splits."""
        _, block = np.unique(ends, return_inverse=True)
        while True:
            _, first, new = np.unique(np.column_stack([block, block[step]]), axis=0, return_index=True, return_inverse=True)
            new = new.ravel()
            if new.max() == block.max():
                break
            block = new
        order = np.argsort(np.where(first == 0, -1, ends[first]), kind="stable")  # the start first, ends last
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return rank[block[step[first[order]]]].astype(np.int32), ends[first[order]]

    def first(self, data: bytes, at: int) -> int:
        """Where the first match that begins at ``at`` or later ends; -1: none."""
        rows, ends, classes, state = self._rows, self._ends, self._class, 0
        for k in range(at, len(data)):
            state = rows[state][classes[data[k]]]
            if ends[state]:
                return k + 1
        return -1

    def longest(self, data: bytes, at: int, step: int = 1, stop: int | None = None) -> int:
        """Where the longest match from ``at`` on ends; -1: none. With step -1 it reads backwards to ``stop``."""
        rows, ends, classes, dead = self._rows, self._ends, self._class, self.dead
        places = range(at, len(data)) if step == 1 else range(at - 1, stop - 1, -1)
        state, found = 0, -1
        for k in places:
            state = rows[state][classes[data[k]]]
            if state == dead:
                break
            if ends[state]:
                found = k + 1 if step == 1 else k
        return found

    def scan(self, texts: list[bytes], lanes: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, rules): the places where matches end, exclusive, in order; rules as bits. A byte
        that no text holds parts the texts."""
        data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        length = -(-len(data) // lanes)
        grid = np.full(lanes * length, 255, dtype=np.uint8)
        grid[: len(data)] = data
        grid = np.ascontiguousarray(self.classes[grid].reshape(lanes, length).T)
        width, flat = self.step.shape[1], self.step.ravel()
        quiet = int(np.argmax(self.ends > 0)) if (self.ends > 0).any() else len(self.ends)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def run(which: np.ndarray, state: np.ndarray, entered: np.ndarray | None) -> np.ndarray:
            """Steps some slices from a state; stops early where it meets the state of the pass before."""
            alive = np.arange(len(which))
            last = state.copy()
            for k in range(length):
                state = flat[state * width + grid[k, which[alive]]]
                if (hit := state >= quiet).any():
                    found.append((which[alive[hit]] * length + k, self.ends[state[hit]]))
                if entered is not None and k % 64 == 63:
                    same = state == self._mid[k // 64][which[alive]]
                    last[alive[same]] = entered[which[alive[same]]]
                    alive, state = alive[~same], state[~same]
                    if not len(alive):
                        return last
                elif entered is None and k % 64 == 63:
                    self._mid.append(state.copy())
            last[alive] = state
            return last

        self._mid: list[np.ndarray] = []
        leave = run(np.arange(lanes), np.zeros(lanes, dtype=np.int64), None)
        came = np.zeros(lanes, dtype=np.int64)
        while True:
            should = np.append(0, leave[:-1])
            late = np.flatnonzero(should != came)
            if not len(late):
                break
            came = should
            old = leave.copy()
            leave[late] = run(late, should[late], old)
        del self._mid
        none = np.zeros(0, dtype=np.int64)
        place, bits = (np.concatenate([none, *(f[i] for f in found)]) for i in (0, 1))
        place, same = np.unique(place, return_inverse=True)  # a slice that was stepped twice says some places twice
        whole = np.zeros(len(place), dtype=np.int64)
        np.bitwise_or.at(whole, same, bits)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        of = np.searchsorted(starts, place, side="right") - 1
        ok = of < len(texts)
        return of[ok], (place - starts[of] + 1)[ok], whole[ok]


@dataclass
class Machines:
    """One automaton for the pass, and for each rule: loose, from a start, its head, backwards."""

    whole: Automaton
    loose: list[Automaton]
    tight: list[Automaton]
    head: list[Automaton | None]
    back: list[Automaton]


_BUILT: list[Machines] = []


def machines() -> Machines:
    if not _BUILT:
        loose, tight, head, back = [], [], [], []
        for r in RULES:
            nfa = Nfa()
            start, end = nfa.parse(r.head + r.body, r.fold)
            loose.append(Automaton(nfa, start, {end: 1}))
            tight.append(Automaton(nfa, start, {end: 1}, False))
            back.append(Automaton(nfa.reversed(), end, {start: 1}, False))
            own = Nfa()
            head.append(Automaton(own, (x := own.parse(r.head, r.fold))[0], {x[1]: 1}, False) if r.head else None)
        _BUILT.append(Machines(Automaton.of([(r.shortest, r.fold) for r in RULES]), loose, tight, head, back))
    return _BUILT[0]


def matches(data: bytes, rule: int, ends: np.ndarray) -> list[tuple[int, int]]:
    """The leftmost spans of a rule that don't overlap, in bytes; ends: where matches end, in order."""
    m, r, out, done, i = machines(), RULES[rule], [], 0, 0
    while True:
        i = int(np.searchsorted(ends, done, side="right"))
        if i == len(ends):
            return out
        start = m.back[rule].longest(data, int(ends[i]), -1, done)
        if start < 0:
            # The end is of a match that began before ``done``.
            end = m.loose[rule].first(data, done)
            if end < 0:
                return out
            start = m.back[rule].longest(data, end, -1, done)
        end = m.tight[rule].longest(data, start)
        body = m.head[rule].longest(data, start) if r.head else start
        if end - body >= r.least:
            out.append((start, end))
        done = end


def scan_texts(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end), in code points, in order."""
    out: list[list[tuple[int, int, int]]] = []
    batch: list[str] = []
    size = 0

    def flush():
        if not batch:
            return
        data = [t.encode("utf-8", "replace") for t in batch]
        of, place, bits = machines().whole.scan(data)
        found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(of)), strict=False):
            k = int(of[lo])
            got = [(s, r, e) for r in range(len(RULES)) if len(ends := place[lo:hi][(bits[lo:hi] >> r & 1) > 0]) for s, e in matches(data[k], r, ends)]
            if got and len(data[k]) != len(batch[k]):
                points = np.append(0, np.cumsum((np.frombuffer(data[k], dtype=np.uint8) & 0xC0) != 0x80))
                got = [(int(points[s]), r, int(points[e])) for s, r, e in got]
            found[k] = sorted(got)
        out.extend(found)
        batch.clear()

    for t in texts:
        batch.append(t)
        size += len(t)
        if size > 1 << 23:
            flush()
            size = 0
    flush()
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), a row for each input row; spans: kind, start and end in code points, end
    exclusive, by start and then by rule.

    Null and empty texts have no spans. Spans of different kinds may overlap. Repeated rows stay. Very
    long texts take time in proportion to their length. Other columns play no part. No rows: no rows.
    """
    arrow_rows(docs.sparkSession, 2000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = scan_texts([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda x: f"array_join(transform({x}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    count = lambda k: F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(joined(base)), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
