"""Conversation structure repair: Dijkstra on the lattice of (turn index, grammar state).

A conversation is well formed when the initials of its roles give ``(s?(ua)+)?``. Edits are kept,
reroled, deleted and inserted turns; the search pops nodes by (cost, audit) and stops at the first
accepting node behind the last turn. Two ways to one node with equal cost never have audits of which
one begins the other (an insertion costs), so the order of audits survives what is appended to both.

A conversation may be of any length. Turns are sorted by range, so a hot one lies in many
partitions; conversations that may cross a partition, or that are longer than CHUNK_TURNS, are cut
into chunks, each searched from all four states to all four, and the chunks' tables of
(cost, audit) are then folded in order. Texts do not take part in that; they are read once more, in
order, to write the repaired turns.

Defined results: a null in any column stands for one space, so turns without text are blank and a
role without name has to be changed. A conversation of null identifier is one conversation. Rows of
one turn are taken by role, then by the MD5 of their text; rows equal in all follow one another, and
the later ones are duplicates. An empty role has no initial and cannot be kept. A conversation whose
turns are all gone has zeros, an empty audit and the hash of nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import HOT_SHARE, is_small, materialize, prepare, shuffle_width, tidy

#: Grammar states: nothing yet, behind a system turn, behind a user turn, behind an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (EMPTY, ASSISTANT)
#: Where a role's initial leads, and the one role that can be put behind a state.
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
PUT = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Fixed values of the contract: pairs of initials that may follow each other, and white space.
LEGAL = ("su", "ua", "au")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Turns that one search takes at most; audits in its queue are no longer than about three times this.
CHUNK_TURNS = 256
ORDER = ("turn", "role", "digest", "copy")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
CHUNK_SCHEMA = """conv_id long, whole boolean, part int, chunk int, n long, low long, high long, n_turns long,
blank long, duplicate long, truncated long, illegal long, first string, last string, starts array<int>, ends array<int>, costs array<long>, audits array<string>"""
EDITS_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS_SCHEMA = "conv_id long, place long, role string, text string, edit string"

Turn = tuple[str, str]  # initial of the role, fault
Way = tuple[int, str]  # cost, audit


def plain_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_copies: the given turns, null role or text as one space, each once."""
    space = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(1).alias("n_copies")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``plain_turns`` with the contract's faults, by the CRC-32 of ``conv_id:turn`` modulo 20; dropped turns have no copy."""
    space, turns = F.lit(" "), plain_turns(conversations)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    case = F.crc32(key) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return turns.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("n_copies")
    )


def in_copies(turns: DataFrame) -> DataFrame:
    """One row for each copy, with ``digest`` for order; a turn without copies keeps one row, its ``copy`` null."""
    return turns.select("*", F.md5("text").alias("digest"), F.explode_outer(F.sequence(F.lit(1), F.when(F.col("n_copies") > 0, F.col("n_copies")))).alias("copy"))


def ending() -> tuple[Column, Column]:
    """(blank, truncated) of ``text``."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    return bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")


def faulty(turns: DataFrame) -> DataFrame:
    """conv_id, ORDER, fault (b, d, t or empty): no text is shuffled.

    A turn is a duplicate when its role and text stand in an earlier turn, or in an equal row before it.
    First turns come from an aggregate with partial sums; only keys of several turns are joined back,
    broadcast where their table is short, and else hot ones apart.
    """
    blank, truncated = ending()
    keys = ["c0", "c1", "role", "digest"]
    rows = in_copies(turns).select(
        "conv_id", *ORDER, F.when(blank, "b").when(truncated, "t").otherwise("").alias("own"), F.coalesce("conv_id", F.lit(0)).alias("c0"), F.col("conv_id").isNull().alias("c1")
    )
    at = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"))
    spread = rows.filter("copy is not null").groupBy(*keys).agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count("*").alias("n"))
    spread = materialize(spread.filter("begin <> end").drop("end"), "repeated")
    if is_small(spread):
        rows = rows.join(F.broadcast(spread), keys, "left")
    else:
        bound = spread.agg(F.sum("n")).first()[0] // HOT_SHARE
        hot = F.broadcast(spread.filter(F.col("n") > bound))
        rest = rows.join(hot.select(*keys), keys, "left_anti").join(spread.filter(F.col("n") <= bound), keys, "left")
        rows = rows.join(hot, keys).unionByName(rest)
    again = (F.col("copy") > 1) | F.coalesce(F.col("begin") < at, F.lit(False))
    return rows.select("conv_id", *ORDER, F.when((F.col("own") != "b") & again, "d").otherwise(F.col("own")).alias("fault"))


def search(turns: list[Turn], entry: int, whole: bool) -> dict[int, Way]:
    """The cheapest edits, as (cost, audit), from ``entry`` to the states behind the last turn.

    For a whole conversation only the first accepting node that is popped counts; for a chunk all do.
    """
    n, queue, done, found = len(turns), [(0, "", 0, entry)], set(), {}
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        role, behind = PUT[state]
        heappush(queue, (cost + INSERT, audit + "I", i, behind))
        if i == n:
            found[state] = (cost, audit)
            if whole and state in ACCEPTING:
                return {state: (cost, audit)}
            continue
        initial, fault = turns[i]
        heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
        if fault in ("b", "d"):
            continue
        extra = TRUNCATED if fault == "t" else 0
        kept = STEP.get((state, initial))
        if kept is not None:
            heappush(queue, (cost + extra, audit + "K", i + 1, kept))
        heappush(queue, (cost + extra + REROLE, audit + "R", i + 1, behind))
    return found


class _Chunk:
    """Turns of one conversation that follow one another, and what is counted in them."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns = conv_id, []
        self.low = self.high = None
        self.n_turns = 0
        self.key: tuple | None = None
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, digest: str, fault: str) -> None:
        if self.key == (turn, role, digest) and fault != "b":
            fault = "d"  # an equal row stands just before
        self.key = (turn, role, digest)
        if turn is not None and turn != self.high:
            self.low, self.high, self.n_turns = turn if self.low is None else self.low, turn, self.n_turns + 1
        if fault:
            self.counts[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
        if self.turns and self.turns[-1][0] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.turns.append((role[:1], fault))

    def row(self, whole: bool, part: int, chunk: int) -> dict:
        ways = [(e, x, *way) for e in ((EMPTY,) if whole else range(4)) for x, way in search(self.turns, e, whole).items()]
        starts, ends, costs, audits = (list(c) for c in zip(*ways, strict=True)) if ways else ([], [], [], [])
        first, last = (self.turns[0][0], self.turns[-1][0]) if self.turns else (None, None)
        return {"conv_id": self.conv_id, "whole": whole, "part": part, "chunk": chunk, "n": len(self.turns), "low": self.low, "high": self.high, "n_turns": self.n_turns, **self.counts,
                "first": first, "last": last, "starts": starts, "ends": ends, "costs": costs, "audits": audits}


def _arrow(schema: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(schema.items()))


_CHUNK = _arrow(
    {"conv_id": pa.int64(), "whole": pa.bool_(), "part": pa.int32(), "chunk": pa.int32(), **dict.fromkeys(("n", "low", "high", "n_turns", *COUNTS), pa.int64()), "first": pa.string(), "last": pa.string(),
     "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
)
_EDITS = _arrow({"conv_id": pa.int64(), "gaps": pa.int64(), **dict.fromkeys((*COUNTS, "cost"), pa.int64()), "audit": pa.string()})
_TURNS = _arrow({"conv_id": pa.int64(), "place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()})
_DIGESTS = _arrow({"conv_id": pa.int64(), "repaired_sha256": pa.string()})


def _searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK_SCHEMA of a sorted partition. Its first and last conversations may go on in the next ones."""
    part, held, out, n_convs, n_chunks = TaskContext.get().partitionId(), None, [], 0, 0
    for batch in it:
        for conv, turn, role, digest, copy, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or conv != held.conv_id:
                if held is not None:
                    out.append(held.row(n_convs > 1 and not n_chunks, part, n_chunks))
                held, n_convs, n_chunks = _Chunk(conv), n_convs + 1, 0
            if copy is None:  # a dropped turn only names its conversation
                continue
            if len(held.turns) == CHUNK_TURNS:
                out.append(held.row(False, part, n_chunks))
                follows, held, n_chunks = held, _Chunk(conv), n_chunks + 1
                held.key = follows.key
            held.add(turn, role, digest, fault)
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHUNK)
            out = []
    if held is not None:
        yield pa.RecordBatch.from_pylist([held.row(False, part, n_chunks)], _CHUNK)


class _Fold:
    """The chunks of one conversation in order: for each state the cheapest way to it, and what is counted."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.shared = conv_id, []
        self.ways: dict[int, Way] = {EMPTY: (0, "")}
        self.low = self.high = self.last = None
        self.n_turns = 0
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, row: dict) -> None:
        for name in COUNTS:
            self.counts[name] += row[name]
        if row["low"] is not None:
            self.n_turns += row["n_turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        if row["n"]:
            if self.last is not None and self.last + row["first"] not in LEGAL:
                self.counts["illegal"] += 1
            self.last = row["last"]
        ways: dict[int, Way] = {}
        for entry, end, cost, audit in zip(row["starts"], row["ends"], row["costs"], row["audits"], strict=True):
            if entry in self.ways:
                way = (self.ways[entry][0] + cost, self.ways[entry][1] + audit)
                ways[end] = min(way, ways.get(end, way))
        begin = commonprefix([audit for _, audit in ways.values()])  # what all states share is settled
        self.shared.append(begin)
        self.ways = {state: (cost, audit[len(begin) :]) for state, (cost, audit) in ways.items()}

    def row(self) -> dict:
        cost, audit = min(self.ways[state] for state in ACCEPTING if state in self.ways)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.shared) + audit}


def _folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []
    for batch in it:
        for row in batch.to_pylist():
            if held is None or row["conv_id"] != held.conv_id:
                if held is not None:
                    out.append(held.row())
                held = _Fold(row["conv_id"])
            held.add(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, _EDITS)
            out = []
    if held is not None:
        yield pa.RecordBatch.from_pylist([held.row()], _EDITS)


def edits(turns: DataFrame) -> DataFrame:
    """EDITS_SCHEMA: for each conversation of ``turns`` (as of ``plain_turns``) its faults, and cost and audit of the repair.

    The result is a table of the shared folder.
    """
    prepare(turns.sparkSession)
    marked = faulty(turns).repartitionByRange(shuffle_width(turns.sparkSession), "conv_id", *ORDER)
    chunks = materialize(marked.sortWithinPartitions("conv_id", *ORDER).mapInArrow(tidy(_searched), CHUNK_SCHEMA), "chunks")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    whole = chunks.filter("whole").select("conv_id", gaps, *COUNTS, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    cut = chunks.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return materialize(whole.unionByName(cut.mapInArrow(tidy(_folded), EDITS_SCHEMA)), "edits")


def _replayed(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text, edit) of the repaired turns; a row of the audit comes before a conversation's turns.

    Each conversation also gives one row without place, when it begins.
    """
    conv, audit, at, state, place = None, "", 0, EMPTY, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role, state = PUT[state]
            yield conv, place, role, "", "I"
            at, place = at + 1, place + 1

    for batch in it:
        for this, edit_list, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "audit", "role", "text")), strict=True):
            if edit_list is not None:
                yield from inserted()
                conv, audit, at, state, place = this, edit_list, 0, EMPTY, 0
                yield conv, None, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role, state = PUT[state]
            else:
                state = STEP[state, role[:1]]
            yield conv, place, role, text, edit
            place += 1
    yield from inserted()


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in _replayed(it):
        if row[1] is not None:
            out.append(dict(zip(_TURNS.names, row, strict=True)))
            size += len(row[3])
        if len(out) == 1000 or size > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, _TURNS)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _TURNS)


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out, conv = None, [], None
    for this, place, role, text, _ in _replayed(it):
        if place is None:
            if held is not None:
                out.append({"conv_id": conv, "repaired_sha256": held.hexdigest()})
            held, conv = hashlib.sha256(), this
        else:
            held.update(f"{'\n' if place else ''}{role}:{text}".encode())
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)
            out = []
    if held is not None:
        out.append({"conv_id": conv, "repaired_sha256": held.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, _DIGESTS)


def _in_order(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """The edits and turns of each conversation in one partition, in order. Tasks read them as a stream, whatever the length."""
    rows = in_copies(turns).filter("copy is not null").select("conv_id", *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    heads = edited.select("conv_id", *(F.lit(None).cast(kind).alias(name) for name, kind in rows.dtypes if name in (*ORDER, "text")), "audit")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)


def repaired_turns(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """TURNS_SCHEMA: the turns of the repaired conversations, their places from 0, and the edit that made each."""
    return _in_order(turns, edited).mapInArrow(tidy(_rows), TURNS_SCHEMA)


def repaired_digests(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired turns as ``role:text``, joined by newlines.

    SHA-256 is sequential, so one task reads a conversation's turns, as a stream.
    """
    return _in_order(turns, edited).mapInArrow(tidy(_hashed), "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """EDITS_SCHEMA and repaired_sha256 for each conversation of ``turns``."""
    edited = edits(turns)
    hashed = repaired_digests(turns, edited).withColumnRenamed("conv_id", "hashed_id")
    same = F.col("conv_id").eqNullSafe(F.col("hashed_id"))
    return edited.join(hashed, same).drop("hashed_id")
