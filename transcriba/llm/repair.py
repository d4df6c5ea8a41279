"""Repair of conversations by error-correcting Earley parsing over roles.

A conversation is well formed if the initials of its roles match (s?(ua)+)?. The grammar says so with
productions whose one nonterminal, if any, stands first, so every item of every chart set begins at the
first turn and a set holds an item at most once. Error productions extend it: a turn may be deleted, a
turn may take another role, an empty turn may be inserted. An item keeps the least (cost, audit) of all
ways to reach it; the completed item of the last set yields the repair.

Audits are not carried along. Of two ways that have read the same turns and end with a turn's edit,
neither can begin the other, so the ways of a set have ranks; an item holds its cost above the set's least,
the rank of its way and the insertions since. Written like that few sets differ: each is made once, and
parsing a turn is one look-up that leaves one number behind, from which the edits are read at the end.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, named

#: Productions; a capital is a nonterminal. First and Conv may be empty, Conv is the goal.
GRAMMAR: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Conv", ()),
    ("Conv", ("Turns",)),
    ("Turns", ("First", "u", "a")),
    ("Turns", ("Turns", "u", "a")),
    ("First", ()),
    ("First", ("s",)),
)
GOAL = "Conv"
#: Roles that may be given or inserted, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits; an undeleted truncated turn adds the last one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Bytes of a conversation's turns held in memory while its end is not known; what goes beyond lies in the task's temporary file.
HELD_BYTES = 8 << 20

Item = tuple[int, int]  # production, dot
Way = tuple[int, int, int]  # cost, rank of the way to the last turn read, insertions since


class Step(NamedTuple):
    """What reading one turn does to a set: the next set, the rise of its least cost, and where its ways come from."""

    to: int
    rise: int
    back: tuple[tuple[int, int, str], ...]  # way before, insertions there, edit of the turn


class Chart:
    """Sets of items, each made once and numbered, and the steps between them."""

    def __init__(self, grammar: tuple[tuple[str, tuple[str, ...]], ...] = GRAMMAR) -> None:
        self.grammar = grammar
        for _, body in grammar:
            if any(x[0].isupper() for x in body[1:]):
                raise ValueError("a nonterminal may stand first in a production only")
        self.sets: list[dict[Item, Way]] = []
        self.known: dict[tuple, int] = {}
        self.steps: list[Step] = []
        self.table: dict[tuple[int, str, bool, bool], int] = {}
        first = {(p, 0): (0, 0, 0) for p, (_, body) in enumerate(grammar) if not body or not body[0][0].isupper()}
        self.first, _, _ = self._number(self._closed(first))

    def _after(self, item: Item) -> str | None:
        body = self.grammar[item[0]][1]
        return body[item[1]] if item[1] < len(body) else None

    def _closed(self, items: dict[Item, Way]) -> dict[Item, Way]:
        """The set with all that completing and inserting add, each item by its least way."""
        out, todo = dict(items), list(items)
        while todo:
            item = todo.pop()
            cost, way, more = out[item]
            reached, nxt = [], self._after(item)
            if nxt is None:  # complete: whatever begins with this nonterminal moves past it
                done = self.grammar[item[0]][0]
                reached = [((p, 1), (cost, way, more)) for p, (_, body) in enumerate(self.grammar) if body[:1] == (done,)]
            elif nxt in ROLES:
                reached = [((item[0], item[1] + 1), (cost + INSERT, way, more + 1))]
            for other, value in reached:
                if other not in out or value < out[other]:
                    out[other] = value
                    todo.append(other)
        return out

    def _number(self, items: dict[Item, Way]) -> tuple[int, int, list[int]]:
        """The number of a set whose costs count from its least and whose ways are those in use; that least, and these ways."""
        least = min(v[0] for v in items.values())
        used = sorted({v[1] for v in items.values()})
        rank = {w: r for r, w in enumerate(used)}
        own = {i: (c - least, rank[w], m) for i, (c, w, m) in items.items()}
        key = tuple(sorted(own.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(own)
        return self.known[key], least, used

    def step(self, at: int, initial: str, must_go: bool, truncated: bool) -> int:
        """The number of the step from a set by a turn of some initial; the set and the step are made if they are new."""
        initial = initial if any(initial in body for _, body in self.grammar) else ""
        key = (at, initial, must_go, truncated)
        if key in self.table:
            return self.table[key]
        extra, best = TRUNCATED if truncated else 0, {}
        for item, (cost, way, more) in self.sets[at].items():
            nxt, ahead = self._after(item), (item[0], item[1] + 1)
            ways = [(item, cost + DELETE, "D")]
            if not must_go and nxt is not None and nxt == initial:
                ways.append((ahead, cost + extra, "K"))
            elif not must_go and nxt in ROLES:
                ways.append((ahead, cost + REROLE + extra, "R"))
            for other, c, edit in ways:
                value = (c, way, "I" * more + edit)
                if other not in best or value < best[other]:
                    best[other] = value
        ends = sorted({v[1:] for v in best.values()})  # by rank, then by letters: neither of two ways begins the other
        rank = {e: r for r, e in enumerate(ends)}
        to, rise, used = self._number(self._closed({i: (v[0], rank[v[1:]], 0) for i, v in best.items()}))
        back = tuple((ends[w][0], len(ends[w][1]) - 1, ends[w][1][-1]) for w in used)
        self.table[key] = len(self.steps)
        self.steps.append(Step(to, rise, back))
        return self.table[key]

    def audit(self, taken: array) -> tuple[int, str]:
        """Least cost and audit of a conversation whose turns took these steps."""
        at = self.steps[taken[-1]].to if taken else self.first
        goal = [v for i, v in self.sets[at].items() if self._after(i) is None and self.grammar[i[0]][0] == GOAL]
        cost, way, more = min(goal)
        letters = ["I" * more]
        for k in reversed(taken):
            cost += self.steps[k].rise
            way, more, edit = self.steps[k].back[way]
            letters.append("I" * more + edit)
        return cost, "".join(reversed(letters))


class Conversation:
    """One conversation in the making: counts, steps, and its turns in a file that leaves memory when it grows."""

    def __init__(self, chart: Chart, held: int) -> None:
        self.chart, self.at, self.taken = chart, chart.first, array("l")
        self.faults, self.illegal, self.last = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.least = self.most = self.turn = None
        self.turns = 0
        self.file = tempfile.SpooledTemporaryFile(held)

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if fault:
            self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.least = turn if self.least is None else self.least
            self.turn = self.most = turn
        k = self.chart.step(self.at, initial, fault in ("blank", "duplicate"), fault == "truncated")
        self.at = self.chart.steps[k].to
        self.taken.append(k)
        r, t = role.encode(), text.encode()
        self.file.write(len(r).to_bytes(8, "little") + len(t).to_bytes(8, "little") + r + t)

    def result(self) -> dict:
        cost, audit = self.chart.audit(self.taken)
        digest, first, expected = hashlib.sha256(), True, "u"
        self.file.seek(0)
        for edit in audit:
            role, text = b"", b""
            if edit != "I":
                n, m = (int.from_bytes(self.file.read(8), "little") for _ in range(2))
                role, text = self.file.read(n), self.file.read(m)
                if edit == "D":
                    continue
            if edit != "K":
                role = ROLES[expected].encode()
            digest.update((b"" if first else b"\n") + role + b":" + text)
            first, expected = False, "a" if role[:1] == b"u" else "u"
        self.file.close()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WHITE = r"\x20\x09-\x0D"


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns go by number, nulls first, then by role and text; turns of one number are all kept. A turn's first
    fault counts: blank (white space only), duplicate (role and text seen before), truncated (the last
    character that is not white space is not one of . ! ?). gaps are numbers missing between the least and
    the greatest; illegal counts neighbours whose initials are not su, ua or au. cost and audit are those of
    the cheapest repair, of several the one whose audit comes first; the digest is of its "role:text"
    lines. present_col names a boolean column: rows where it is false or null only name their conversation.

    Null roles and texts count as one space, so they are blank turns or turns of no role. A null id is a conversation
    of its own. Repeated rows are duplicates of the first; texts of any length are hashed whole; other
    columns are ignored; a conversation without turns has zeros, an empty audit and the hash of nothing; an
    empty table gives an empty result.

    A conversation is read in order by one task, as its digest demands, but never held by it: Spark sorts (and
    spills) its turns, a turn leaves one number behind, and turns wait for the end in a file.
    """
    present = F.coalesce(named(present_col), F.lit(False)) if present_col else F.lit(True)
    role, text = F.coalesce(named(role_col).cast("string"), F.lit(" ")), F.coalesce(named(text_col).cast("string"), F.lit(" "))
    rows = turns.select(named(conv_col).alias("c"), named(turn_col).cast("long").alias("t"), role.alias("r"), text.alias("x"), present.alias("p")).repartition("c")
    # Conversations lie whole in a partition, so this window needs a sort and no exchange.
    seen = F.row_number().over(Window.partitionBy("c", "p", "r", "x").orderBy(F.col("t").asc_nulls_first()))
    fault = F.when(~F.col("p"), None).when(~F.col("x").rlike(f"[^{_WHITE}]"), "blank").when(F.col("n") > 1, "duplicate").when(~F.col("x").rlike(rf"[.!?][{_WHITE}]*\z"), "truncated")
    rows = rows.withColumn("n", seen).select("c", "t", "r", F.when(F.col("p"), F.col("x")).alias("x"), "p", fault.alias("f"), "n")
    rows = rows.sortWithinPartitions("c", F.col("t").asc_nulls_first(), "r", "x", "n")
    id_type = rows.schema["c"].dataType
    of_id = rows.select("c").schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        chart, names = Chart(), [*FIELDS, "audit", "repaired_sha256"]
        types = [to_arrow_schema(of_id).field(0).type, *[pa.int64()] * len(FIELDS), pa.string(), pa.string()]
        held: Conversation | None = None
        own, done = None, []

        def out() -> pa.RecordBatch:
            cols = [[c for c, _ in done], *[[r[k] for _, r in done] for k in names]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(cols, types, strict=True)], ["c", *names])

        for batch in batches:
            for c, t, r, x, p, f in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if held is None or c != own:
                    if held is not None:
                        done.append((own, held.result()))
                    held, own = Conversation(chart, held_bytes), c
                if p:
                    held.add(t, r, x, f)
            if done:
                yield out()
                done = []
        if held is not None:
            done.append((own, held.result()))
            yield out()

    schema = f"c {id_type.simpleString()}, " + ", ".join(f"{k} bigint" for k in FIELDS) + ", audit string, repaired_sha256 string"
    return rows.drop("n").mapInArrow(parse, schema).select(F.col("c").alias(conv_col), *FIELDS, "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of conversations, damaged by the CRC-32 of "conv_id:turn" modulo 20.

    0 drops the row (present is false), 1 empties its text, 2 takes its . ! ? out, 3 repeats it, 4 makes its
    role user. Nulls in role, text and the key count as one space; the turn itself stays null.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("k"))
    x = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), x.alias("text"), (F.col("k") != 0).alias("present"), times.alias("_")).drop("_")
