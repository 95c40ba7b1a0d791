"""Periodic runs of words, found on a Re-Pair grammar of each text."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import rows_of, table

LEAST = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)  # any odd number serves
#: Period candidates that are looked at together, which bounds memory.
CHUNK = 1 << 20


def replace_pairs(ids: list[int], cuts: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Re-Pair: the most frequent pair of neighbouring symbols becomes a new
    symbol, until no pair occurs twice. No pair reaches over a position of
    ``cuts``. Of equally frequent pairs the one of the smaller symbols is first.

    Gives the inner nodes of all derivations as (symbol, start, boundary, end),
    where boundary is the start of the right half, and the starts of the symbols
    that are left.
    """
    n = len(ids)
    sym, size = list(ids), [1] * n
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    for c in [*cuts, n]:
        right[c - 1] = -1
        if c < n:
            left[c] = -1
    fresh = max(ids, default=0) + 1
    base = fresh + n  # no more symbols than this
    at: dict[int, list[int]] = {}
    for i in range(n - 1):
        if right[i] >= 0:
            at.setdefault(sym[i] * base + sym[i + 1], []).append(i)
    known = {pair: len(where) for pair, where in at.items() if len(where) > 1}
    queue = [(-c, pair) for pair, c in known.items()]
    heapify(queue)
    nodes = []
    while queue:
        c, pair = heappop(queue)
        if known.get(pair, 0) != -c:
            if known.get(pair, 0) > 1:
                heappush(queue, (-known[pair], pair))
            continue
        a, b = divmod(pair, base)
        there = [i for i in at.pop(pair) if sym[i] == a and right[i] >= 0 and sym[right[i]] == b]
        places, taken = [], -1
        for i in there:  # a place that overlaps the one before is left out
            if i != taken:
                places.append(i)
                taken = right[i] if a == b else -1
        del known[pair]
        if len(places) < 2:
            continue
        if len(places) < -c:  # counts are upper bounds, exact once they come first
            at[pair], known[pair] = there, len(places)
            heappush(queue, (-len(places), pair))
            continue
        made: dict[int, list[int]] = {}
        for i in places:
            j = right[i]
            before, after = left[i], right[j]
            nodes.append((fresh, i, j, j + size[j]))
            if before >= 0:
                old = sym[before] * base + a
                if old in known and sym[before] != a:  # places of equal symbols may overlap
                    known[old] -= 1
                made.setdefault(sym[before] * base + fresh, []).append(before)
            if after >= 0:
                old = b * base + sym[after]
                if old in known and sym[after] != b:
                    known[old] -= 1
                made.setdefault(fresh * base + sym[after], []).append(i)
                left[after] = i
            sym[i], sym[j], right[i] = fresh, -1, after
            size[i] += size[j]
        for new, where in made.items():
            if len(where) > 1:
                at[new], known[new] = where, len(where)
                heappush(queue, (-len(where), new))
        fresh += 1
    return nodes, [i for i in range(n) if sym[i] >= 0]


def _close(starts: list[int], n: int, cuts: list[int]) -> list[tuple[int, int, int, int]]:
    """Nodes over the symbols that are left, by twos, until one node spans each
    stretch. They occur once and share the symbol -1."""
    nodes, cut = [], set(cuts)
    level = [*starts, n]
    while len(level) > 2:
        kept = [level[0]]
        i = 0
        while i + 1 < len(level) - 1:
            if level[i + 1] in cut:
                i += 1
            else:
                nodes.append((-1, level[i], level[i + 1], level[i + 2]))
                i += 2
            kept.append(level[i])
        if kept[-1] != n:
            kept.append(n)
        if len(kept) == len(level):
            break
        level = kept
    return nodes


class _Ranks:
    """For 1, 2, 4, ... words: equal numbers at two places mean equal words there."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.levels, width = [ids], 1
        room = ends - np.arange(len(ids))
        while True:
            whole = np.flatnonzero(room >= 2 * width)
            if not len(whole):
                break
            last = self.levels[-1]
            pairs = last[whole] * np.int64(len(ids) + 1) + last[whole + width]
            out = np.full(len(ids), -1, np.int64)
            out[whole] = np.unique(pairs, return_inverse=True)[1]
            self.levels.append(out)
            width *= 2

    def ahead(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from ``x`` and ``y`` on are equal, where y > x stays below ``limit``."""
        got = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.levels))):
            todo = np.flatnonzero(y + got + (1 << k) <= limit)
            level = self.levels[k]
            same = level[x[todo] + got[todo]] == level[y[todo] + got[todo]]
            got[todo[same]] += 1 << k
        return got

    def back(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before ``x`` and ``y`` are equal, where x < y stays at or above ``limit``."""
        got = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.levels))):
            todo = np.flatnonzero(x - got - (1 << k) >= limit)
            level, width = self.levels[k], 1 << k
            same = level[x[todo] - got[todo] - width] == level[y[todo] - got[todo] - width]
            got[todo[same]] += width
        return got


def _crossing(ranks: _Ranks, nodes: np.ndarray, least: int) -> np.ndarray:
    """Rows (node, start, end, period): the parts of runs that cross the boundary
    of a node, relative to its start. ``nodes`` has start, boundary and end."""
    found = []
    per_node = nodes[:, 2] - nodes[:, 0]
    cuts = np.searchsorted(np.cumsum(per_node), np.arange(CHUNK, int(per_node.sum()) + CHUNK, CHUNK)) + 1
    # At least half of ``least`` words in a row equal those a period on, so some
    # of them lie together on one side of the boundary.
    level = 1 if least >= 5 else 0
    gram, width, lo = ranks.levels[level], 1 << level, 0
    for hi in cuts:
        part = nodes[lo:hi]
        if len(part):
            sizes = part[:, 2] - part[:, 0]
            at = np.repeat(np.arange(lo, lo + len(part)), sizes)
            step = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            s, b, e = nodes[at, 0], nodes[at, 1], nodes[at, 2]
            # The first periods shift words to the right of the boundary, the rest to its left.
            shift = step <= e - b
            q = np.where(shift, step, step - (e - b))
            x = np.where(shift, b, b - q)
            y = x + q
            near = np.zeros(len(at), bool)
            f = np.flatnonzero(y + width <= e)
            near[f] = gram[x[f]] == gram[y[f]]
            f = np.flatnonzero(x - width >= s)
            near[f] |= gram[x[f] - width] == gram[y[f] - width]
            at, q, x, y, s, e = at[near], q[near], x[near], y[near], s[near], e[near]
            fore, rear = ranks.ahead(x, y, e), ranks.back(x, y, s)
            start, end = x - rear, y + fore
            ok = end - start >= np.maximum(least, 2 * q)
            found.append(np.stack((at, start - s, end - s, q), axis=1)[ok])
        lo = hi
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    # Where several periods give one stretch, its smallest is its period.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[:len(rows)]]


def _stretches(ids: np.ndarray, group: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of words outside which no run can lie, as (start, end).

    In a run each window of ``least // 2`` words has an equal one a period away,
    and these windows cover it without a gap. So only words covered by windows
    that occur again count, and this holds again within each stretch.
    """
    width = max(1, least // 2)
    where = np.arange(len(ids))
    while True:
        n = len(where)
        if n < least:
            return []
        new = np.append(True, (np.diff(where) != 1) | (np.diff(group) != 0))
        piece = np.cumsum(new)
        mark = piece.astype(np.uint64)
        for j in range(width):
            mark[:n - width + 1] = mark[:n - width + 1] * _MIX + ids[where[j:n - width + 1 + j]].astype(np.uint64)
        whole = np.flatnonzero(piece[:n - width + 1] == piece[width - 1:])
        _, at, counts = np.unique(mark[whole], return_inverse=True, return_counts=True)
        whole = whole[counts[at] > 1]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, whole, 1)
        np.add.at(edge, whole + width, -1)
        on = np.cumsum(edge[:n]) > 0
        # Stretches too short for a run go as well.
        begins = np.flatnonzero(on & (new | ~np.append(False, on[:-1])))
        ends = np.flatnonzero(on & np.append(new[1:] | ~on[1:], True)) + 1
        long = ends - begins >= least
        edge = np.zeros(n + 1, np.int64)
        edge[begins[long]] = 1
        np.add.at(edge, ends[long], -1)
        on = np.cumsum(edge[:n]) > 0
        if on.all():
            return [(int(where[b]), int(where[e - 1]) + 1) for b, e in zip(begins[long], ends[long], strict=True)]
        where, group = where[on], group[on]


class _Numbers(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Per text the rows (start, length, period) of its runs, by start, then period.

    The texts get a grammar each. Runs that cross a boundary inside a symbol are
    computed once for the symbol, where it first stands, and translated to all
    places that derive it. A maximal run crosses the boundary of the smallest
    node that contains it, so it is among them whole; parts of it that smaller
    nodes see are merged into it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    numbered = _Numbers().__getitem__
    ids = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(numbered, t), np.int64, len(t)) for t in texts]])
    owner = np.repeat(np.arange(len(texts)), sizes)
    spans = _stretches(ids, owner, least)
    if not spans:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    # From here on: the words of the stretches alone, one after the other.
    begins = np.array([b for b, _ in spans])
    lengths = np.array([e - b for b, e in spans])
    base = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.unique(np.concatenate([ids[b:e] for b, e in spans]), return_inverse=True)[1].astype(np.int64)
    ends = np.repeat(base[1:], lengths)
    of = owner[begins]
    first: dict[tuple[int, ...], int] = {}
    distinct, uses, use_at = [], [], []
    lo = 0
    while lo < len(spans):
        hi = int(np.searchsorted(of, of[lo], "right"))
        at = int(base[lo])
        cuts = (base[lo + 1:hi] - at).tolist()
        seq = flat[at:int(base[hi])].tolist()
        nodes, rest = replace_pairs(seq, cuts)
        nodes += _close(rest, len(seq), cuts)
        for symbol, start, mid, end in nodes:
            if end - start >= least:
                key = (lo, symbol) if symbol >= 0 else (lo, -1, mid, end)
                node = first.get(key)
                if node is None:
                    node = first[key] = len(distinct)
                    distinct.append((at + start, at + mid, at + end))
                uses.append(node)
                use_at.append(at + start)
        lo = hi
    ranks = _Ranks(flat, ends)
    parts = _crossing(ranks, np.array(distinct, np.int64).reshape(-1, 3), least)
    # Every place of a node has the runs of the node.
    uses, use_at = np.array(uses, np.int64), np.array(use_at, np.int64)
    order = np.argsort(uses, kind="stable")
    uses, use_at = uses[order], use_at[order]
    lo, hi = np.searchsorted(uses, parts[:, 0], "left"), np.searchsorted(uses, parts[:, 0], "right")
    times = hi - lo
    row = np.repeat(np.arange(len(parts)), times)
    place = use_at[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]
    start, end, q = place + parts[row, 1], place + parts[row, 2], parts[row, 3]
    # Of one period, an interval within an earlier or longer one is part of it.
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    reach = q * np.int64(len(flat) + 1) + end
    whole = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])[:len(reach)]
    start, end, q = start[whole], end[whole], q[whole]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least_q = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[:len(start)]
    start, end, q = start[least_q], end[least_q], q[least_q]
    stretch = np.searchsorted(base, start, "right") - 1
    doc = of[stretch]
    runs = np.stack((start - base[stretch] + begins[stretch] - offset[doc], end - start, q), axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], doc))
    runs, doc = runs[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [runs[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats: all but its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str | Column = "text", least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (start, length, period; word numbers from
    0) and collapsed, the words that no run repeats, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of at least ``least``
    words and two periods that no neighbouring word extends; its period is the
    smallest. Runs are ordered by start, then period. Null and empty texts have
    no runs and collapse to nothing. Repeated rows and ids are judged each for
    itself; other columns are not read, whatever their names; an empty table
    gives no rows. A text is one unit of work: a task holds the grammar of one
    text, and of as many small ones as make up 4 MB.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).cast("binary").alias("t"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [(t.as_py() or b"").split() for t in batch.column(1)]
            found = find_runs(texts, least)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in found]
            short = [collapsed(ws, r) for ws, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(run)), pa.array(short, pa.binary())], names=["doc_id", "runs", "collapsed"])

    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    return src.mapInArrow(work, schema)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """One text in ten, by the hash of its id, repeats words from some place on."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    ws = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.nullif(F.size(ws).cast("long"), F.lit(0))
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    # One struct keeps a and p from being computed anew for each word.
    made = F.transform(F.array(F.struct(ws.alias("w"), a.alias("a"), p.alias("p"))), lambda r: F.array_join(F.concat(
        F.slice(r["w"], F.lit(1), r["a"].cast("int")),
        F.transform(F.sequence(F.lit(0).cast("long"), F.size(r["w"]) - r["a"] - 1), lambda i: F.get(r["w"], (r["a"] + i % r["p"]).cast("int")))), " "))
    return F.when((h % 10 == 0) & n.isNotNull(), made[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", with_planted_period(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    out = periodic_runs(docs).withColumn("b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.n").alias("length"), (-F.col("b.p")).alias("period"),
        F.floor(F.col("b.n") * 1000 / -F.col("b.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
