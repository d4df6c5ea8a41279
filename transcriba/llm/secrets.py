"""Secret scans by one deterministic automaton for all rules.

Each rule is a byte regex. Subset construction over all rules at once, then minimisation, give one
transition array over byte classes. A state holds, rule by rule, the match attempts under way, ordered
by where they began; a register keeps each beginning. A transition may move registers and may emit the
leftmost, longest match of some rules that ends there; then the rule looks on behind it. So one pass
over the bytes gives the non-overlapping spans of all rules; those under a rule's least length are
dropped. Texts run through the array in step, one gather per byte position for all of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, text_bytes

# -- regex to automaton -----------------------------------------------------------------------------


class _Parser:
    """A byte regex of literals, escapes, classes, groups, |, ?, *, + and {n} to an epsilon automaton."""

    def __init__(self, rule: str, fold: bool) -> None:
        self.s, self.i, self.fold = rule, 0, fold
        self.eps: dict[int, list[int]] = defaultdict(list)
        self.step: dict[int, list[tuple[frozenset[int], int]]] = defaultdict(list)
        self.n = 0

    def state(self) -> int:
        self.n += 1
        return self.n - 1

    def alternatives(self) -> tuple[int, int]:
        ends = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            ends.append(self.sequence())
        if len(ends) == 1:
            return ends[0]
        a, b = self.state(), self.state()
        for x, y in ends:
            self.eps[a].append(x)
            self.eps[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self.repeated()
            self.eps[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        at = self.i
        x, y = self.atom()
        stop = self.i
        if self.i < len(self.s) and self.s[self.i] in "?*+":
            op = self.s[self.i]
            self.i += 1
            a, b = self.state(), self.state()
            self.eps[a].append(x)
            self.eps[y].append(b)
            if op in "?*":
                self.eps[a].append(b)
            if op in "*+":
                self.eps[y].append(x)
            return a, b
        if self.i < len(self.s) and self.s[self.i] == "{":
            end = self.s.index("}", self.i)
            times = int(self.s[self.i + 1 : end])
            for _ in range(times - 1):
                self.i = at
                u, v = self.atom()
                self.eps[y].append(u)
                y = v
            self.i = end + 1
            return x, y
        self.i = stop
        return x, y

    def atom(self) -> tuple[int, int]:
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            out = self.alternatives()
            self.i += 1
            return out
        a, b = self.state(), self.state()
        self.step[a].append((self.byte_set(), b))
        return a, b

    def one(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def byte_set(self) -> frozenset[int]:
        found: set[int] = set()
        if self.s[self.i] != "[":
            found.add(self.one())
        else:
            self.i += 1
            while self.s[self.i] != "]":
                a = self.one()
                b = a
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    b = self.one()
                found.update(range(a, b + 1))
            self.i += 1
        if self.fold:
            found |= {x ^ 32 for x in found if 65 <= (x & ~32) <= 90}
        return frozenset(found)


@dataclass
class Automaton:
    """classes: byte -> class; step: state x class -> state; action: state x class -> row of actions (0: none).

    State 0 starts. An action emits the rules of emit[action] (a bit set), whose first registers hold
    where the matches began, and then register r takes the value of moves[action, r]: another register,
    or the present position where that is -1.
    """

    classes: np.ndarray
    step: np.ndarray
    action: np.ndarray
    emit: np.ndarray
    moves: np.ndarray
    registers: list[int]  # first register of each rule

    def lists(self) -> tuple[list[int], list[int], list[int], list[list[tuple[int, int]]]]:
        """step (times the number of classes), action, emit and the registers that each action changes, made once."""
        if not hasattr(self, "_lists"):
            changes = [[(r, x) for r, x in enumerate(row) if x != r] for row in self.moves.tolist()]
            self._lists = (self.step.ravel() * self.step.shape[1]).tolist(), self.action.ravel().tolist(), self.emit.tolist(), changes
        return self._lists


def _search_step(groups: tuple, accept: int, start: frozenset, move) -> tuple[tuple, list[int], bool]:
    """One rule's next groups of attempts, where their registers come from, and whether a match ended before the byte.

    groups: sets of states, one for each beginning, earliest first. A match is under way when the first
    group accepts; later beginnings then lie inside it and are dropped. Once a group accepts it must
    go on accepting until it dies, so that a match ends where its attempt does; other rules are refused.
    """
    matching = bool(groups) and accept in groups[0]
    after, source, seen = [], [], set()
    for g, states in enumerate(groups):
        to = move(states) - seen
        if to:
            after.append(to)
            source.append(g)
            seen |= to
    ended = matching and not after
    if matching and after and accept not in after[0]:
        raise ValueError("a rule whose match may go on without a match at each byte")
    if not matching or ended:
        to = move(start) - seen
        if to:
            after.append(to)
            source.append(-1)
    if any(accept in states for states in after[1:]):
        raise ValueError("a rule whose later beginning may match before an earlier one is settled")
    if after and accept in after[0]:
        after, source = after[:1], source[:1]
    return tuple(frozenset(x) for x in after), source, ended


def compile_rules(rules: list[tuple[str, bool]]) -> Automaton:
    """One minimal automaton for all rules (regex, fold ASCII case)."""
    parts = []
    for rule, fold in rules:
        p = _Parser(rule, fold)
        parts.append((p, *p.alternatives()))
    sets = sorted({bs for p, _, _ in parts for to in p.step.values() for bs, _ in to}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in bs for bs in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    @lru_cache(maxsize=None)
    def closure(k: int, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in parts[k][0].eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    @lru_cache(maxsize=None)
    def next_of(k: int, groups: tuple, byte: int) -> tuple[tuple, list[int], bool]:
        p, first, last = parts[k]
        return _search_step(groups, last, closure(k, first), lambda states: {x for s in states for bs, t in p.step[s] if byte in bs for x in closure(k, t)})

    empty = tuple(() for _ in rules)
    numbers, todo, table, found = {empty: 0}, [empty], [], []
    while todo:  # subset construction; states are numbered in the order in which they are met
        now = todo.pop(0)
        row, acts = [], []
        for byte in sample:
            nexts = [next_of(k, groups, byte) for k, groups in enumerate(now)]
            key = tuple(n[0] for n in nexts)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append(numbers[key])
            acts.append((tuple(tuple(n[1]) for n in nexts), sum(1 << k for k, n in enumerate(nexts) if n[2])))
        table.append(row)
        found.append(acts)
    width = [max(len(state[k]) for state in numbers) for k in range(len(rules))]
    registers = np.concatenate([[0], np.cumsum(width)]).tolist()
    moves, emit, at = [tuple(range(registers[-1]))], [0], {}
    at[moves[0], 0] = 0
    action = np.zeros((len(table), len(sample)), np.int32)
    for i, acts in enumerate(found):
        for c, (sources, ended) in enumerate(acts):
            move = list(moves[0])
            for k, source in enumerate(sources):
                for r, x in enumerate(source):
                    move[registers[k] + r] = -1 if x < 0 else registers[k] + x
            key = (tuple(move), ended)
            if key not in at:
                at[key] = len(moves)
                moves.append(key[0])
                emit.append(ended)
            action[i, c] = at[key]
    return minimise(Automaton(classes, np.array(table, np.int32), action, np.array(emit, np.int32), np.array(moves, np.int16), registers[:-1]))


def minimise(a: Automaton) -> Automaton:
    """Refines the partition of states by what their transitions do and where they lead until it is stable."""
    block = np.unique(a.action, axis=0, return_inverse=True)[1].ravel()
    while True:
        key = np.column_stack([block, block[a.step]])
        new = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = np.full(block.max() + 1, -1)
    for s in range(len(block) - 1, -1, -1):
        first[block[s]] = s
    order = np.argsort(first)  # the start's block comes first
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return Automaton(a.classes, rank[block[a.step[first[order]]]].astype(np.int32), a.action[first[order]], a.emit, a.moves, a.registers)


# -- rules ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """kind; regex; fold ASCII case; least length of a match that is kept."""

    kind: str
    regex: str
    fold: bool
    least: int


_VALUE = r"[A-Za-z0-9+/_.=\-]"
_NAME = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = ("assign", "access", "hex")
#: Characters of the value of an assignment that is kept.
ASSIGN_CHARS = 6
#: In the order in which kinds are listed.
RULES = (
    Rule("assign", _NAME + _VALUE + "+", True, 0),
    Rule("access", "AKIA[A-Z0-9]+", False, 20),
    Rule("hex", "[0-9a-f]+", False, 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", False, 40),
    Rule("google", "AIza[A-Za-z0-9_-]+", False, 39),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", False, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
)


# -- scanning ---------------------------------------------------------------------------------------

#: Bytes between the places at which texts are cut; a stretch of more than four times as many without one runs alone.
PIECE = 1024
#: Ends every text: no rule has it in a match.
SEPARATOR = 10


def _cuts(cls: np.ndarray, a: Automaton, piece: int) -> np.ndarray:
    """Places behind two bytes that lead every state to the start, the first at or after each multiple of piece."""
    home = a.step == 0
    k = home.shape[1]
    pair = np.array([[home[a.step[:, c], d].all() for d in range(k)] for c in range(k)])
    ok = np.flatnonzero(pair[cls[:-1], cls[1:]]) + 2
    return np.unique(ok[np.minimum(np.searchsorted(ok, np.arange(0, len(cls), piece)), len(ok) - 1)]) if len(ok) else ok


def matches(data: np.ndarray, ends: np.ndarray, a: Automaton, least: list[int], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, end) of all matches of at least a rule's least length, in no order.

    data holds texts that end in SEPARATOR, which leads every state to the start; ends are their ends.
    """
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    cls = a.classes[data]
    cut = np.unique(np.concatenate([[0], _cuts(cls, a, piece), ends]))
    start, stop = cut[:-1], cut[1:]
    alone = stop - start > 4 * piece
    for x, y in zip(start[alone].tolist(), stop[alone].tolist(), strict=True):
        got.append(_run_alone(cls[x:y].tobytes(), x, a, least))
    start, length = start[~alone], (stop - start)[~alone]
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    if len(start):
        k = a.step.shape[1]
        step, action = np.ascontiguousarray(a.step.ravel()) * k, np.ascontiguousarray(a.action.ravel())
        emit, to, source = a.emit, *_changes(a.moves)
        width = a.moves.shape[1] + 2  # one more holds the present position, one takes what has no place
        state, register = np.zeros(len(start), np.int32), np.zeros(len(start) * width, np.int64)
        live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
        for i, m in enumerate(live.tolist()):
            at = state[:m] + cls[start[:m] + i]
            state[:m] = step[at]
            act = action[at]
            j = np.flatnonzero(act)
            if not len(j):
                continue
            act, position, own = act[j], start[j] + i, j * width
            out = emit[act]
            for r in range(len(a.registers)) if out.any() else ():
                on = np.flatnonzero(out >> r & 1)
                began = register[own[on] + a.registers[r]]
                long = position[on] - began >= least[r]
                if long.any():
                    got.append((np.full(int(long.sum()), r), began[long], position[on][long]))
            register[own + (width - 2)] = position
            register[own[:, None] + to[act]] = register[own[:, None] + source[act]]
    return tuple(np.concatenate([g[i] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64) for i in range(3))


def _changes(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The registers that each action changes and where their values come from, in rows of equal length."""
    n, width = moves.shape
    rows = [np.flatnonzero(row != np.arange(width)) for row in moves]
    most = max(len(r) for r in rows)
    to, source = np.full((n, most), width + 1), np.full((n, most), width)
    for i, r in enumerate(rows):
        to[i, : len(r)] = r
        source[i, : len(r)] = np.where(moves[i, r] < 0, width, moves[i, r])
    return to, source


def _run_alone(cls: bytes, base: int, a: Automaton, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same over one long stretch, byte by byte."""
    step, action, emit, changes = a.lists()
    out, register, state = [], [0] * a.moves.shape[1], 0
    for position, c in enumerate(cls, base):
        at = state + c
        state = step[at]
        act = action[at]
        if act:
            if emit[act]:
                for r, first in enumerate(a.registers):
                    if emit[act] >> r & 1 and position - register[first] >= least[r]:
                        out.append((r, register[first], position))
            new = [(r, position if x < 0 else register[x]) for r, x in changes[act]]
            for r, x in new:
                register[r] = x
    return tuple(np.array([o[i] for o in out], np.int64) for i in range(3))


def find_secrets(texts: list[bytes], a: Automaton, rules: tuple[Rule, ...] = RULES, piece: int = PIECE) -> list[list[tuple[int, int, int]]]:
    """(start, rank of the kind, end) in code points of each text's spans, in order."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    rule, start, end = matches(data, ends, a, [r.least for r in rules], piece)
    order = np.argsort(start, kind="stable")
    rule, start, end = rule[order], start[order], end[order]
    owner = np.searchsorted(ends, start, side="right")
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d in np.unique(owner).tolist():
        text, first = texts[d], int(ends[d]) - len(texts[d]) - 1
        before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        for i in range(*np.searchsorted(owner, [d, d + 1]).tolist()):
            x, y, k = int(start[i]) - first, int(end[i]) - first, int(rule[i])
            if rules[k].kind != "assign" or _value_length(text[x:y]) >= ASSIGN_CHARS:
                found[d].append((int(before[x]), k, int(before[y])))
        found[d].sort()
    return found


def _value_length(match: bytes) -> int:
    """Bytes of the value of an assignment: what follows the first : or =, spaces and a quote."""
    at = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1
    while match[at : at + 1] == b" ":
        at += 1
    return len(match) - at - (match[at : at + 1] in (b'"', b"'"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, batch_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every text, by start, then kind as listed.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; a text of any length
    is scanned whole, in time in proportion to its length; repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.
    """
    automaton = compile_rules([(r.regex, r.fold) for r in rules]).__dict__  # plain data
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton(**automaton)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= batch_bytes):
                    size += len(texts[stop])
                    stop += 1
                found = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in f] for f in find_secrets(texts[at:stop], own, rules)]
                yield pa.record_batch([batch.column(0).slice(at, stop - at), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])
                at = stop

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_bytes(text_col))
    return rows.mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(found: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans of a column, comma-joined; kinds restricts them."""
    keep = F.col(found) if kinds is None else F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(keep, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_kind(found: str, kind: str):
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


