"""Repair of conversation structure: the cheapest edits that give each conversation an order of roles the grammar accepts.

The grammar is ``(s?(ua)+)?`` over the initials of roles: a system turn or none, then user and assistant in turn; or nothing. A
conversation is a lattice of nodes (turns read, grammar state). Dijkstra's search walks it from (0, start), making nodes as it
reaches them; the key is (cost, audit), the audit being the edits' initials so far, and the first accepting end node that is
popped is the answer. Two paths to one node at one cost are never prefixes of each other (what one has more are inserts, and
these cost), so the order of keys stays the order of what follows.

A conversation may be as long as the table. Rows are sorted by ranges of (conversation, turn, role, text), so a long one lies in
many tasks, and each of them walks its part in segments of ``SEGMENT`` rows: from every grammar state to every other one. A
conversation that a task holds whole is then finished there; of those that it may share with its neighbours the segments are sent
on, and Dijkstra's search over (segment, grammar state) puts them together, one segment in memory at a time, with a running digest
for each state.
Rows that are equal in all are counted, not sorted: all but the first are deleted, so their number is enough.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut, row_key

#: Rows of a lattice that is walked at once; segments of one conversation that a task holds before it sends them on.
SEGMENT = 256
HELD = 64
REROLE, DELETE, INSERT, RAGGED = 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
#: Grammar states: nothing yet, a system turn, a user turn, an assistant turn. What may follow, by initial of the role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that an insert, or a change of role, makes in a state.
MADE = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
ACCEPTING = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")


class Turn:
    """A row as the lattice sees it. ``copies``: rows equal to it, itself included; ``gone``: blank, or said before; ``ragged``: its sentence has no end."""

    __slots__ = ("role", "text", "copies", "gone", "ragged")

    def __init__(self, role: str, text: str | None, copies: int, gone: bool, ragged: bool):
        self.role, self.text, self.copies, self.gone, self.ragged = role, text, copies, gone, ragged


def walk(turns: list[Turn], entry: int, whole: bool = False) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from (0, ``entry``) to the end nodes by their state: all that can be reached, or with ``whole`` the first
    accepting one alone."""
    heap, done, ends, n = [(0, "", 0, entry)], set(), {}, len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if whole and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        made = MADE[state][0]
        if (i, made) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, made))
        if i == n:
            continue
        t = turns[i]
        more = t.copies - 1
        after = cost + DELETE * more
        heapq.heappush(heap, (after + DELETE, audit + "D" * t.copies, i + 1, state))
        if not t.gone:
            extra = after + (RAGGED if t.ragged else 0)
            to = NEXT.get(t.role[:1], {}).get(state)
            if to is not None:
                heapq.heappush(heap, (extra, audit + "K" + "D" * more, i + 1, to))
            heapq.heappush(heap, (extra + REROLE, audit + "R" + "D" * more, i + 1, made))
    return ends


def repaired(turns: list[Turn], entry: int, audit: str) -> Iterator[str]:
    """The lines ``role:text`` that the edits of ``audit`` leave."""
    state, i, k = entry, 0, 0
    while k < len(audit):
        edit = audit[k]
        if edit == "I":
            state, role = MADE[state]
            yield f"{role}:"
            k += 1
            continue
        t = turns[i]
        if edit == "K":
            state = NEXT[t.role[:1]][state]
            yield f"{t.role}:{t.text}"
        elif edit == "R":
            state, role = MADE[state]
            yield f"{role}:{t.text}"
        i += 1
        k += t.copies


class Facts:
    """Counts over rows in order, which can be put together: gaps, faults and illegal neighbours."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "distinct", "first_turn", "last_turn")
    __slots__ = FIELDS

    def __init__(self, *values):
        self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.distinct, self.first_turn, self.last_turn = values or (0, 0, 0, 0, 0, None, None, None, None, 0, None, None)

    def values(self) -> list:
        return [getattr(self, f) for f in self.FIELDS]

    def add(self, other: Facts) -> None:
        """What follows these rows."""
        if not other.rows:
            return
        self.illegal += other.illegal + bool(self.rows and self.tail + other.head not in LEGAL)
        self.head = other.head if not self.rows else self.head
        self.tail = other.tail
        if other.distinct:
            self.distinct += other.distinct - (self.last_turn == other.first_turn and self.distinct > 0)
            self.low = other.low if self.low is None else min(self.low, other.low)
            self.high = other.high if self.high is None else max(self.high, other.high)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        for f in ("rows", "blank", "duplicate", "truncated"):
            setattr(self, f, getattr(self, f) + getattr(other, f))

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.distinct if self.distinct else 0


def read(turn: int | None, role: str, text: str, copies: int, first: bool) -> tuple[Turn, Facts]:
    """A row, judged."""
    body = text.rstrip(BLANKS)
    blank, ragged = not body, bool(body) and body[-1] not in ".!?"
    gone, k = blank or not first, role[:1]
    faults = (copies, 0, 0) if blank else (0, copies - first, int(ragged and first))
    given = (turn, turn, 1, turn, turn) if turn is not None else (None, None, 0, None, None)
    return Turn(role, None if gone else text, copies, gone, ragged and not gone), Facts(copies, *faults, copies - 1, k, k, *given)


class Fold:
    """Segments of a conversation, in order, put together: Dijkstra's search over (segment, grammar state), layer by layer."""

    def __init__(self):
        self.facts, self.kept = Facts(), []
        self.live = {START: (0, "", hashlib.sha256())}  # cost, audit behind what all have in common, digest of the lines

    def add(self, turns: list[Turn], facts: Facts, ways=None) -> None:
        """``ways(entry)``: {exit: (cost, audit)}, if it is known."""
        self.facts.add(facts)
        best: dict[int, tuple[int, str, int, str]] = {}
        for entry, (cost, audit, _) in self.live.items():
            for leave, (more, edits) in (ways(entry) if ways else walk(turns, entry)).items():
                found = (cost + more, audit + edits, entry, edits)
                if leave not in best or found[:2] < best[leave][:2]:
                    best[leave] = found
        live = {}
        for leave, (cost, audit, entry, edits) in best.items():
            digest = self.live[entry][2].copy()
            lines = "\n".join(repaired(turns, entry, edits))
            if lines:
                digest.update((("\n" if entry != START else "") + lines).encode("utf-8", "replace"))
            live[leave] = (cost, audit, digest)
        common = os.path.commonprefix([a for _, a, _ in live.values()])
        self.kept.append(common)
        self.live = {s: (c, a[len(common) :], d) for s, (c, a, d) in live.items()}

    def row(self, conv) -> list:
        cost, audit, digest = min((self.live[s] for s in ACCEPTING if s in self.live), key=lambda x: x[:2])
        f = self.facts
        return [conv, f.gaps(), f.blank, f.duplicate, f.truncated, f.illegal, cost, "".join(self.kept) + audit, digest.hexdigest()]


def _whole(conv, turns: list[Turn], facts: Facts) -> list:
    """The row of a conversation of one segment."""
    [(_, (cost, audit))] = walk(turns, START, whole=True).items()
    digest = hashlib.sha256("\n".join(repaired(turns, START, audit)).encode("utf-8", "replace")).hexdigest()
    return [conv, facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, digest]


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_FACTS = "rows bigint, f_blank bigint, f_duplicate bigint, f_truncated bigint, f_illegal bigint, head string, tail string, low bigint, high bigint, distinct bigint, first_turn bigint, last_turn bigint"
_TURNS = "roles array<string>, texts array<string>, copies array<bigint>, gone array<boolean>, ragged array<boolean>"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "int": pa.int32()}


def _batch(schema: str, rows: list[list]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _rows(batches, step: int):
    for b in batches:
        for a in range(0, b.num_rows, step):
            part = b.slice(a, step)
            yield from zip(*(c.to_pylist() for c in part.columns))


def _segments(schema: str):
    """Of a task's sorted rows: finished conversations, and the segments of those that may go on in other tasks."""
    none = [None] * (len(RESULT.split(", ")))

    def run(batches):
        at, k, out = TaskContext.get().partitionId(), 0, []
        conv, begun, shared, turns, facts, pending = None, False, True, [], Facts(), []

        def sent(segment):
            nonlocal k
            ts, f = segment
            ways = [w.get(s) for w in (walk(ts, entry) for entry in range(4)) for s in range(4)]
            k += 1
            columns = [[t.role for t in ts], [t.text for t in ts], [t.copies for t in ts], [t.gone for t in ts], [t.ragged for t in ts]]
            return [conv, *none, at, k, *f.values(), *columns, [w and w[0] for w in ways], [w and w[1] for w in ways]]

        def closed(open_end: bool):
            """Rows for the conversation that ends here, or ends this task's rows."""
            if shared or open_end:
                yield from map(sent, [*pending, (turns, facts)])
            elif not pending:
                yield [*_whole(conv, turns, facts), *[None] * (len(schema.split(", ")) - 9)]
            else:
                fold = Fold()
                for ts, f in [*pending, (turns, facts)]:
                    fold.add(ts, f)
                yield [*fold.row(conv), *[None] * (len(schema.split(", ")) - 9)]

        for c, turn, role, text, copies, first in _rows(batches, 1000):
            if begun and c != conv:
                out += closed(False)
                shared, turns, facts, pending = False, [], Facts(), []
            conv, begun = c, True
            if copies:
                t, f = read(turn, role, text, copies, first)
                turns.append(t)
                facts.add(f)
            if len(turns) == SEGMENT:
                pending.append((turns, facts))
                turns, facts = [], Facts()
                if len(pending) > HELD:
                    shared = True
                if shared:
                    out += map(sent, pending)
                    pending = []
            if len(out) >= 500:
                yield _batch(schema, out)
                out = []
        if begun:
            out += closed(True)
        yield _batch(schema, out)

    return run


def _joined(batches):
    """Of segments sorted by conversation and place: a row for each conversation."""
    fold, conv, out, n = None, None, [], len(Facts.FIELDS)
    for c, _, _, *rest in _rows(batches, 8):
        if fold and c != conv:
            out.append(fold.row(conv))
            fold = None
        fold, conv = fold or Fold(), c
        roles, texts, copies, gone, ragged, costs, audits = rest[n:]
        ways = lambda entry: {s: (costs[4 * entry + s], audits[4 * entry + s]) for s in range(4) if costs[4 * entry + s] is not None}  # noqa: B023, E731
        fold.add([Turn(*t) for t in zip(roles, texts, copies, gone, ragged)], Facts(*rest[:n]), ways)
        if len(out) >= 500:
            yield _batch("conv_id bigint, " + RESULT, out)
            out = []
    if fold:
        out.append(fold.row(conv))
    yield _batch("conv_id bigint, " + RESULT, out)


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """``turns``: conv_id, turn, role, text. A row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``.

    ``copies``: how often a row counts, 1 if it isn't given; a row that counts 0 times names its conversation only, and one with no
    other rows has zeros, an empty audit and the digest of the empty text. A null role or text is one space; a null conv_id is a
    conversation of its own; null turns come first and count for no gap; rows of one turn follow (role, text). A role counts by its
    first character; an empty one, or one that the grammar doesn't know, can only be changed or deleted. Texts of any length are
    read whole, and conversations of any length too. Other columns are ignored; an empty table gives none.
    """
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"))
    here = F.col("copies") > 0
    t = t.select("conv_id", *(F.when(here, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
    t = cut(t.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    k1, k2 = row_key(F.col("conv_id"), F.col("role"), F.col("text"))
    t = t.withColumns({"k1": k1, "k2": k2})
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    seen = t.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.count("*").alias("turns")).where("turns > 1")
    seen = seen.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("place.turn").alias("earliest"))
    t = t.join(seen, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    t = t.select("conv_id", "turn", "role", "text", "copies", (F.col("s1").isNull() | F.col("turn").eqNullSafe(F.col("earliest"))).alias("first"))
    # bounds of ranges go through the driver: a start of role and text is enough for them, and in the same order
    near = F.when(F.length("role") <= 32, F.substring("text", 1, 32))
    t = t.repartitionByRange("conv_id", "turn", F.substring("role", 1, 33), near).sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = f"conv_id bigint, {RESULT}, at int, k bigint, {_FACTS}, {_TURNS}, costs array<bigint>, audits array<string>"
    found = cut(t.mapInArrow(_segments(parts), parts))
    names = ["conv_id", *(f.split()[0] for f in RESULT.split(", "))]
    rest = found.where("at is not null").drop(*names[1:])
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").mapInArrow(_joined, "conv_id bigint, " + RESULT)
    return found.where("at is null").select(*names).unionByName(rest)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by the CRC of ``conv_id:turn`` mod 20: 0 drops the row (``copies`` 0), 1 empties its text, 2 takes its
    ends of sentences away, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """``repair`` of all conversations, damaged."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("copies"))


def _best(*options: str) -> str:
    """The least (cost, audit) of states, null where there is none."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _more(state: str, cost: str, edit: str, line: str = "''", only: str = "TRUE") -> str:
    return f"CASE WHEN ({state}) IS NOT NULL AND {only} THEN {{'c': ({state}).c + {cost}, 'a': ({state}).a || '{edit}', 't': ({state}).t || {line}}} END"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_KEPT, _AS_USER, _AS_ASSISTANT = "r.role || ':' || r.text || chr(10)", "'user:' || r.text || chr(10)", "'assistant:' || r.text || chr(10)"
_ITS = "NOT r.gone AND r.initial = '{}'"
#: A recursive walk over the rows of all conversations at once: the four grammar states before a row, with inserts, and after it.
SQL = f"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
faulty AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM keyed, table_of),
after AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, range(2) AS copy(n) WHERE fault <> 0 AND (n = 0 OR fault = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial FROM after),
judged AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS ragged,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
r AS (SELECT *, blank OR again AS gone, CASE WHEN ragged THEN 1 ELSE 0 END AS extra FROM judged),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i + 1, {_more("w.e", "3", "D")},
    {_best(_more("w.s", "3", "D"), _more("w.e", "r.extra", "K", _KEPT, _ITS.format("s")))},
    {_best(_more("w.u", "3", "D"), *(_more(f"w.{x}", "r.extra", "K", _KEPT, _ITS.format("u")) for x in "esa"), *(_more(f"w.{x}", "2 + r.extra", "R", _AS_USER, "NOT r.gone") for x in "esa"))},
    {_best(_more("w.a", "3", "D"), _more("w.u", "r.extra", "K", _KEPT, _ITS.format("a")), _more("w.u", "2 + r.extra", "R", _AS_ASSISTANT, "NOT r.gone"))}
  FROM (
    SELECT conv_id, i, e, s, u, {_best("a", _more("u", "2", "I", _ASSISTANT))} AS a
    FROM (SELECT conv_id, i, e, s, a, {_best("u", *(_more(x, "2", "I", _USER) for x in "esa"))} AS u FROM walk)) w
  JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE NOT gone AND ragged) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, {_best("w.e", "w.a", _more("w.u", "2", "I", _ASSISTANT), *(_more(x, "4", "II", _USER + " || " + _ASSISTANT) for x in ("w.e", "w.s")))} AS best
  FROM walk w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(f.n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(CASE WHEN best.t = '' THEN '' ELSE left(best.t, length(best.t) - 1) END) AS repaired_sha256
FROM ends
"""
