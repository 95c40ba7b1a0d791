"""Repair of conversations by a weighted grammar over spans of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import table

#: Costs of the edits; a truncated turn that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Copies that the table of first turns is dealt to, so that a hot one is not a hot key.
SALTS = 16

# The wanted role initials are (s?(ua)+)?. A nonterminal (p, q) stands for the
# turns that lead from place p to place q of that pattern: 0 before everything,
# 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
_STEPS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
_PLACES, _ENDS = range(4), (0, 3)
Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


def joined(left: Cells, right: Cells) -> Cells:
    """The rules (p, q) -> (p, r) (r, q) applied to two neighbouring spans.

    A cell is the least (cost, audit). Of one span no audit is a proper prefix of
    another of the same cost, since both have a letter a turn and insertions
    cost, so the least of the parts give the least of the whole.
    """
    out: Cells = {}
    for (p, r), (c1, a1) in left.items():
        for q in _PLACES:
            other = right.get((r, q))
            if other is not None:
                made = (c1 + other[0], a1 + other[1])
                if (p, q) not in out or made < out[p, q]:
                    out[p, q] = made
    return out


def _closure() -> Cells:
    """Cells of no turns at all: insertions alone, any number of them."""
    cells: Cells = {(p, p): (0, "") for p in _PLACES}
    one = {(p, q): (INSERT, "I") for p, who, q in _STEPS if who != "s"}
    for _ in _PLACES:
        longer = joined(cells, {**{(p, p): (0, "") for p in _PLACES}, **one})
        cells = {k: min(v, cells.get(k, v)) for k, v in longer.items()}
    return cells


INSERTED = _closure()


@lru_cache(maxsize=4096)
def turn_cells(initial: str, must_go: bool, truncated: bool, copies: int) -> Cells:
    """Cells of one turn with ``copies - 1`` repetitions behind it, and the
    insertions that may follow. Repetitions are duplicates, so they go."""
    more, late = TRUNCATED * truncated, DELETE * (copies - 1)
    cells: Cells = {(p, p): (DELETE, "D") for p in _PLACES}
    if not must_go:
        cells |= {(p, q): (REROLE + more, "R") for p, who, q in _STEPS if who != "s"}
        cells |= {(p, q): (more, "K") for p, who, q in _STEPS if who == initial}
    tail = "D" * (copies - 1)
    return joined({k: (c + late, a + tail) for k, (c, a) in cells.items()}, INSERTED)


class Chart:
    """Cells of a growing row of turns, combined bottom-up by span length.

    Spans have 1, 2, 4, ... turns and begin at a multiple of their length; a span
    is filled as soon as both halves are. Nonterminals join at every turn alike,
    so one split of a span gives its cells, and the others give the same.
    """

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cells]] = []

    def add(self, cells: Cells, length: int = 1) -> None:
        while self.spans and self.spans[-1][0] <= length:
            before, left = self.spans.pop()
            cells, length = joined(left, cells), length + before
        self.spans.append((length, cells))

    def cells(self) -> Cells | None:
        whole = None
        for _, cells in reversed(self.spans):
            whole = cells if whole is None else joined(cells, whole)
        return whole


def cheapest(cells: Cells | None) -> Cell:
    """The least (cost, audit) of all turns; insertions may also come first."""
    if cells is None:
        return 0, ""
    whole = joined(INSERTED, cells)
    return min(whole[0, q] for q in _ENDS if (0, q) in whole)


class Repairer:
    """Follows an audit over turns and names the roles of the turns that result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.lines = audit, 0, 0, 0

    def _line(self, initial: str | None, role: str | None, text: str) -> str:
        if initial is None:  # a new role: the only one that fits here but system
            initial = "a" if self.place == 2 else "u"
            role = "assistant" if initial == "a" else "user"
        self.place = next(q for p, who, q in _STEPS if (p, who) == (self.place, initial))
        self.lines += 1
        return ("\n" if self.lines > 1 else "") + f"{role}:{text}"

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._line(None, None, "")

    def turn(self, role: str, text: str, copies: int) -> Iterator[str]:
        """The lines of a turn, and of the insertions before it."""
        for _ in range(copies):
            yield from self.inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                yield self._line(role[:1], role, text)
            elif edit == "R":
                yield self._line(None, None, text)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` rows (conv_id, turn, role, text) with faults by the hash of their place."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with equal ones counted together,
    and ``seen``: whether an earlier turn has the same role and text.

    First turns are least values, with partial sums in each task. Only roles and
    texts that stand at several turns are looked up again, by a key that is
    salted on both sides.
    """
    rows = cut_lineage(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
                       .withColumn("said", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text").cast("binary"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns come first
    firsts = rows.groupBy("conv_id", "said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = cut_lineage(firsts.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"))
    dealt = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & (F.col("of") == F.col("salt"))
    both = rows.withColumn("of", salt).join(dealt, on, "left")
    seen = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return both.select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"))


_BLANK = " \t\n\x0b\x0c\r"
_CELL = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")
_SEGMENT = {"part": pa.int32(), "turns": pa.int64(), "first_role": pa.string(), "last_role": pa.string(), "first_turn": pa.int64(), "last_turn": pa.int64(),
            **{c: pa.int64() for c in _COUNTS}, "cells": pa.list_(_CELL)}
_SEGMENT_SQL = ("part int, turns bigint, first_role string, last_role string, first_turn bigint, last_turn bigint, "
                + ", ".join(f"{c} bigint" for c in _COUNTS) + ", cells array<struct<p:int,q:int,cost:bigint,audit:string>>")


class _Segment:
    """What the turns of a conversation that lie in one partition come to."""

    def __init__(self) -> None:
        self.chart, self.turns = Chart(), 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        said = text.strip(_BLANK)
        blank = not said
        cut = not blank and not seen and said[-1] not in ".!?"
        if turn is not None:
            if self.last_turn != turn:
                self.counts["distinct"] += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if self.last_role is None:
            self.first_role = role[:1]
        else:
            self.counts["illegal"] += self.last_role + role[:1] not in ("su", "ua", "au")
        self.last_role = role[:1]
        self.counts["illegal"] += copies - 1  # a role does not follow itself
        if blank:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - 1 + seen
            self.counts["truncated"] += cut
        self.chart.add(turn_cells(role[:1], blank or seen, cut, copies))
        self.turns += copies

    def row(self, part: int) -> dict:
        return {"part": part, "turns": self.turns, "first_role": self.first_role, "last_role": self.last_role, **self.counts,
                "first_turn": self.first_turn, "last_turn": self.last_turn,
                "cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in (self.chart.cells() or {}).items()]}


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each conversation and partition of ``rows``, which are in order."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, found, now, held, kind = [], [], None, 0, None

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(ids, kind), *[pa.array([f[n] for f in found], t) for n, t in _SEGMENT.items()]]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_SEGMENT])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text, copies, seen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != ids[-1]:
                    if now is not None:
                        found.append(now.row(part))
                        held += now.turns
                        if held > 50_000:
                            yield flush()
                            ids, found, held = [], [], 0
                    ids.append(conv)
                    now = _Segment()
                now.add(turn, role, text, copies, seen)
        if now is not None:
            found.append(now.row(part))
            yield flush()

    return rows.mapInArrow(work, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_SEGMENT_SQL}")


def _merged(found: list[dict]) -> dict:
    """Segments of one conversation, a few partitions of it, to its result."""
    found = sorted(found, key=lambda f: f["part"])
    chart = Chart()
    out = {k: sum(f[k] for f in found) for k in _COUNTS}
    for a, b in zip(found, found[1:]):
        out["illegal"] += a["last_role"] + b["first_role"] not in ("su", "ua", "au")
    last = None
    for f in found:
        if f["first_turn"] is not None:
            out["distinct"] -= f["first_turn"] == last  # one turn on both sides of a border
            last = f["last_turn"]
        chart.add({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in f["cells"]}, f["turns"])
    cost, audit = cheapest(chart.cells())
    distinct = out.pop("distinct")
    low = next((f["first_turn"] for f in found if f["first_turn"] is not None), None)
    gaps = 0 if low is None else last - low + 1 - distinct
    return {"gaps": gaps, **out, "cost": cost, "audit": audit}


def repaired(turns: DataFrame, *, order: list[str] = ["turn", "role", "text"]) -> DataFrame:  # noqa: B006
    """Per conversation of ``turns`` (conv_id, turn, role, text, copies; nulls in
    conv_id and turn only): gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256.

    Turns are taken by number, null ones first, and those of one number by role,
    then text; rows that are equal throughout are repetitions. A null conv_id is
    a conversation, texts and roles may be empty or long. Conversations without
    rows give no row. Other columns are not read, whatever their names.

    Turns are sorted over the whole cluster, so that a conversation of any length
    lies in as many partitions as its rows fill. A partition makes the cells of
    its part of a conversation; of these, one row a partition, a conversation is
    put together. The digest of the repaired text reads its turns one by one: it
    is a single chain by definition, and its task holds an audit and one batch.
    """
    rows = marked(turns)
    rows = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    segments = cut_lineage(_segments(rows))
    key = segments.schema["conv_id"].dataType.simpleString()
    plan = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()) | {"audit": pa.string()}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_merged(f) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[n] for f in found], t) for n, t in plan.items()]], names=["conv_id", *plan])

    parts = segments.groupBy("conv_id").agg(F.collect_list(F.struct(*[c for c in segments.columns if c != "conv_id"])).alias("found"))
    plans = cut_lineage(parts.mapInArrow(merge, f"conv_id {key}, " + ", ".join(f"{n} {'string' if n == 'audit' else 'bigint'}" for n in plan)))

    # The audit of a conversation comes before its turns, in the same stream.
    null = lambda t: F.lit(None).cast(t)
    heads = plans.select("conv_id", F.lit(0).alias("kind"), null("bigint").alias("turn"), null("string").alias("role"), null("string").alias("text"),
                         null("bigint").alias("copies"), "audit")
    body = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    body = body.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", null("string").alias("audit"))
    stream = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, todo, sha, key_type = [], [], None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, key_type), pa.array(sums, pa.string())], names=["c", "repaired_sha256"])

        def close() -> None:
            for line in todo.inserted():
                sha.update(line.encode())
            sums.append(sha.hexdigest())

        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, kind, _, role, text, copies, audit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:
                    if todo is not None:
                        close()
                    if len(ids) >= 10_000:
                        yield out()
                        ids, sums = [], []
                    ids.append(conv)
                    todo, sha = Repairer(audit), hashlib.sha256()
                else:
                    for line in todo.turn(role, text, copies):
                        sha.update(line.encode())
        if todo is not None:
            close()
            yield out()

    sums = stream.mapInArrow(digest, f"c {key}, repaired_sha256 string")
    return plans.join(sums, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repaired(cut_lineage(damaged(turns)))
    ids = turns.select(F.col("conv_id").alias("c")).distinct()
    zero = {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = ids.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    out = out.na.fill({**zero, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
    return out.select(F.col("c").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
