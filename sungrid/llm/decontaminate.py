"""Benchmark passages in training texts, found by a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import WORD_BYTES, rows_of, table, words

WINDOW = 13
#: Items are matched in blocks of so many words, which bounds the automaton.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All word sequences of a set of items; the longest one that ends at each
    word of a text is tracked word by word.

    ``owners`` has, for a state, the items that contain its sequences.
    """

    def __init__(self, items: dict[str, list[bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self._own = [-1], [0], [set()]
        self.short: dict[int, dict[int, set[str]]] = {}  # by state: length of a whole short item, its ids
        self.least = WINDOW
        for item, seq in items.items():
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in seq]
            last = 0
            for w in ids:
                last = self._extend(last, w)
                self._own[last].add(item)
        for item, seq in items.items():
            if 0 < len(seq) < WINDOW:
                self.least = min(self.least, len(seq))
                at = 0
                for w in seq:
                    at = self.next[at][self.vocab[w]]
                self.short.setdefault(at, {}).setdefault(len(seq), set()).add(item)
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= WINDOW:
                self._own[self.link[s]] |= self._own[s]

    def _new(self, length: int, link: int, arcs: dict[int, int], own: set[str]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self._own.append(own)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the longest sequence of ``p`` followed by ``w``."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), set())
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        cur = self._new(self.length[last] + 1, 0, {}, set())
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, w)
        return cur

    def spans(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, words, items) of each window that occurs in a run of known words."""
        at, length = 0, 0
        nxt, link, longest, short = self.next, self.link, self.length, self.short
        for i, w in enumerate(ids):
            while at and w not in nxt[at]:
                at = link[at]
                length = longest[at]
            if w not in nxt[at]:
                continue
            at, length = nxt[at][w], length + 1
            if length < self.least:
                continue
            s = at
            while s > 0:
                if length >= WINDOW and longest[link[s]] < WINDOW <= min(longest[s], length if s == at else longest[s]):
                    yield i + 1, WINDOW, self._own[s]
                for n, items in short.get(s, {}).items():
                    if n <= length:
                        yield i + 1, n, items
                s = link[s]

    def hits(self, text: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Starts and ends (two columns) of the hit spans, and the items found."""
        get = self.vocab.get
        ids = np.array(list(map(get, text, repeat(-1))), np.int64)
        # A window lies within a run of words that items know.
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        runs, found, items = known.reshape(-1, 2), [], set()
        for lo, hi in runs[runs[:, 1] - runs[:, 0] >= self.least]:
            for end, n, own in self.spans(ids[lo:hi].tolist()):
                found.append((lo + end - n, lo + end))
                items |= own
        return np.array(found, np.int64).reshape(-1, 2), items


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[dict[str, list[bytes]]]:
    """Items in blocks of bounded size, in which an item is whole. The driver holds
    one block at a time; several blocks come from a table written in their order,
    of which each reads its own part."""
    src = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    bytes_in = src.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-bytes_in // (BLOCK_WORDS * 6)))
    if n > 1:
        # a hash of both: items that share an id do not share a block
        src = src.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
        src = cut_lineage(src.repartitionByRange("block").sortWithinPartitions("block"))
    for k in range(n):
        block: dict[str, list[bytes]] = {}
        part = src if n == 1 else src.where(F.col("block") == k)
        for r in part.select("i", "t").toLocalIterator():
            if ws := words(bytes(r.t)):
                # items that repeat an id stay apart until they are counted
                block[f"{r.i}\x00{len(block)}"] = ws
        if block:
            yield block


def match_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, one_in: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans (word positions, merged) and the ``keep`` columns.

    A window is 13 consecutive item words, or a whole shorter item. A text is
    contaminated when at least one in ``one_in`` of its words is hit. Null and
    empty texts have no words and no hits; items without words have no window;
    no items give no hits; a null item id counts as an empty one, and items of one
    id as one item. Repeated rows are judged each for itself.

    Each block of items is an automaton that every task holds; texts stream past
    it. Blocks are bounded by BLOCK_WORDS. Between two blocks the rows are written,
    with the merged spans so far in a column that grows with the hits of the text
    alone, and the block is let go. A text is one unit of work.
    """
    keep = keep or []
    spark = docs.sparkSession
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    now = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_t"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
                      F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    sent = None
    for block in chain(_blocks(items, item_id, item_text), [None]):
        if block is None and sent is not None:
            break
        if sent is not None:
            now = cut_lineage(now)
            sent.unpersist()
        # Tasks build the automaton from the block: its words are small to send,
        # its states are not.
        sent = spark.sparkContext.broadcast(block or {})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made = SuffixAutomaton(sent.value)
            for batch in rows_of(batches):
                at = {n: i for i, n in enumerate(batch.schema.names)}
                n_words, spans, found = [], [], []
                for t, old, had in zip(batch.column(at["_t"]), batch.column(at["spans"]), batch.column(at["items"]), strict=True):
                    ws = words(t.as_py())
                    hit, ids = made.hits(ws)
                    n_words.append(len(ws))
                    if old.is_valid:
                        hit = np.concatenate((hit, np.array(old.as_py(), np.int64).reshape(-1, 2)))
                    if len(hit):
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], covered(hit, len(ws)), [0])).astype(np.int8)))
                        spans.append(edges.tolist())
                    else:
                        spans.append(None)
                    ids = {i.partition("\x00")[0] for i in ids} | set(had.as_py() or ())
                    found.append(sorted(ids) or None)
                new = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for n, i in at.items()], names=list(at))

        schema = now.schema
        now = now.mapInArrow(run, schema)
    n_hit = F.expr("coalesce(aggregate(sequence(0, size(spans) - 1), 0L, (a, i) -> a + if(i % 2 = 1, spans[i], -spans[i])), 0L)")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    out = now.withColumn("n_hit", F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n_hit))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"),
        "spans", *[F.col(n).alias(c) for c, n in names.items()])


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose hit words stay below the coverage limit, with
    all their columns and their text as it was. Nulls, empty texts and repeated
    rows stay."""
    keep = docs.columns
    judged = match_items(docs, items, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, keep=keep)
    # Columns of docs may have the names of measures: take them by position.
    at = len(judged.columns) - len(keep)
    renamed = judged.toDF(*[f"c{i}" for i in range(len(judged.columns))])
    return renamed.where(~F.col("c5")).select(*[F.col(f"c{at + i}").alias(c) for i, c in enumerate(keep)])


def remove_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", longest: int = WINDOW - 1, one_in: int = 20) -> DataFrame:
    """``docs`` without what benchmark items left in them, all columns kept.

    Texts whose hit words reach the coverage limit (one in ``one_in``) go. From the
    others each matched span (overlapping and touching windows are one) of more
    than ``longest`` words is cut out, with what stands between its words; a shorter
    span, of a short item, stays. All else of a text keeps its bytes. Nulls, empty
    texts and rows without hits come back as they were; repeated rows are treated
    each for itself.
    """
    keep = docs.columns
    judged = match_items(docs, items, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, keep=keep, one_in=one_in)
    at = len(judged.columns) - len(keep)
    rows = judged.toDF(*[f"c{i}" for i in range(len(judged.columns))]).where(~F.col("c5"))
    name = f"c{at + keep.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            k = batch.schema.get_field_index(name)
            out = []
            for t, spans in zip(batch.column(k), batch.column(0), strict=True):
                t, long = t.as_py(), [(lo, hi) for lo, hi in np.array(spans.as_py() or (), np.int64).reshape(-1, 2).tolist() if hi - lo > longest]
                out.append(cut_spans(t.encode(), long).decode() if long else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == k else batch.column(i) for i in range(1, batch.num_columns)], names=batch.schema.names[1:])

    rows = rows.select(F.col(f"c{at - 1}").alias("spans"), *[F.col(f"c{at + i}") for i in range(len(keep))])
    return rows.mapInArrow(run, rows.drop("spans").schema).toDF(*keep)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what lies between them."""
    flat = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat, [0])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at:edge[lo, 0]])
        at = edge[hi - 1, 1]
    return b"".join([*out, text[at:]])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
