"""Near duplicates by SimHash, with Hamming distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import rows_of, table, tokens
from .components import components
from .exact_dedup import sha256

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Cut into BLOCKS runs of bits, two fingerprints that differ in MAX_BITS bits agree on BLOCKS - MAX_BITS whole runs.
BLOCKS = 6
REFERENCES = 16
_LANES = np.uint64(0x0001000100010001)
_MOST = 0xFFFF  # shingles that a 16-bit lane can count


def _hashes(ws: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the shingles: slices of the words joined by single spaces."""
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(ws))
    pairs = zip(starts[: len(ws) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, len(ws) - size + 1)


def _majority(hashes: list[np.ndarray]) -> list[int]:
    """For each text, the bits set in over half of its hashes, as a signed long."""
    pieces, owner = [], []
    for i, h in enumerate(hashes):
        for at in range(0, len(h), _MOST):
            pieces.append(h[at:at + _MOST])
            owner.append(i)
    n = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    if pieces:
        flat = np.concatenate(pieces)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1]))
        for b in range(16):  # four bits at a time, each in a lane of 16 bits
            sums = np.add.reduceat((flat >> np.uint64(b)) & _LANES, starts)
            for lane in range(4):
                np.add.at(counts[:, b + 16 * lane], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(_MOST)).astype(np.int64))
    bits = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little")
    return bits.view(np.int64)[:, 0].tolist()


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, marked: bool = False) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a long, one row per row;
    ``marked`` adds m, the digest of the text, null as empty.

    Shingles are of ``size`` words, repeats included; a shorter text is one
    shingle; a text without words (null too) has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1 << 20):
            made = []
            for t in batch.column(1):
                ws = tokens(t.as_py())
                made.append(_hashes(ws, size) if ws else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_majority(made), pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", "m"][:batch.num_columns])

    more = [sha256(F.coalesce(F.col(text), F.lit(""))).alias("m")] if marked else []
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"), *more)
    return src.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp bigint" + ", m string" * marked)


def _run_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, *, most: int = MAX_BITS, blocks: int = BLOCKS, references: int = REFERENCES) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that join the
    same components as all pairs at ``most`` or fewer differing bits.

    A distance table holds, for each fingerprint, its distances to ``references``
    fixed reference fingerprints, and in each bucket the one to the bucket's own
    reference, its smallest member. By the triangle inequality a pair is within
    reach only if no coordinate differs by more than ``most``; what is left is
    verified. Members within ``most`` bits of their bucket's reference link to it
    alone: their pairs are then connected and are neither formed nor listed, so a
    cluster of n fingerprints around one costs n links.

    Buckets are exact: of ``blocks`` runs of bits, any pair within reach agrees on
    some choice of ``blocks - most`` whole runs, and there is a table for each choice.
    """
    runs = _run_masks(blocks)
    masks = [_signed(reduce(lambda x, y: x | y, c)) for c in combinations(runs, blocks - most)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    heads = keyed.groupBy("t", "key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = keyed.join(heads, ["t", "key"]).withColumn("dh", _distance(F.col("fp"), F.col("head")))
    refs = [xxhash.xxh64_intdigest(i.to_bytes(2, "little"), SEED) for i in range(references)]
    coords = [_distance(F.col("fp"), F.lit(_signed(r))).cast("tinyint").alias(f"d{i}") for i, r in enumerate(refs)]
    near = cut_lineage(near.select("t", "key", "fp", "head", F.col("dh").cast("tinyint").alias("dh"), *coords))
    stars = near.where((F.col("dh") <= most) & (F.col("fp") != F.col("head"))).select(F.col("fp").alias("a"), F.col("head").alias("b"))

    names = ["dh", *[f"d{i}" for i in range(references)]]
    # A side holds the members out of reach of the reference; the other all of them.
    far = near.where(F.col("dh") > most).select("t", "key", *[F.col(c).alias(f"x_{c}") for c in ["fp", *names]])
    on = [F.col(c) == F.col(f"y_{c}") for c in ("t", "key")]
    other = near.select(F.col("t").alias("y_t"), F.col("key").alias("y_key"), *[F.col(c).alias(f"y_{c}") for c in ["fp", *names]])
    x, y = F.col("x_fp"), F.col("y_fp")
    reach = reduce(lambda p, q: p & q, [F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) <= most for c in names])
    reach &= (x < y) | ((F.col("y_dh") <= most) & (x != y))
    reach &= _distance(x, y) <= most
    # A pair that shares several buckets counts in the first table only.
    first = reduce(lambda rest, im: F.when(x.bitwiseXOR(y).bitwiseAND(F.lit(im[1])) == 0, F.lit(im[0])).otherwise(rest), reversed(list(enumerate(masks))), F.lit(-1))
    reach &= (first == F.col("t")) | (F.col("y_dh") <= most)
    pairs = far.join(other, reduce(lambda p, q: p & q, on) & reach).select(x.alias("a"), y.alias("b"))
    return stars.union(pairs)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Every row of ``docs`` as (doc_id, fingerprint, component_id).

    component_id is the smallest doc_id reachable over links of fingerprints at
    ``most`` or fewer differing bits, the row's own included. Texts without words
    (null too) have fingerprint zero and link like any other. Null ids take part
    but never are the smallest, unless all of a component are null. Repeated rows
    give repeated results; no rows give none.
    """
    made = cut_lineage(fingerprints(docs, doc_id=doc_id, text=text, size=size))
    distinct = cut_lineage(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct.select("fp"), most=most), "a", "b")
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Exactly one row of each component of ``docs``, with all its columns: the one
    with the smallest doc_id, a null id after all others; then the smallest
    fingerprint, then the smallest digest of the text. Of rows equal in id and
    text one stays, whatever its other columns hold.
    """
    made = cut_lineage(fingerprints(docs, doc_id=doc_id, text=text, size=size, marked=True))
    # Structs compare field by field; false is before true.
    distinct = cut_lineage(made.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "fp", "m")).alias("best"), F.count("*").alias("n")))
    found = components(links(distinct.select("fp"), most=most), "a", "b")
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "n", "best", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    named = cut_lineage(rooted.drop("best").join(best, "root").select("fp", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.m").alias("keep_m")))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("m") == F.col("keep_m"))
    met = made.join(named, "fp").select(F.col("doc_id").alias("i"), "m", "n", same.alias("stays")).where("not stays or n > 1")
    met = cut_lineage(met)
    lost = met.where("not stays").select("i", "m").distinct()
    ties = cut_lineage(met.where("stays").groupBy("i", "m").agg(F.count("*").alias("k")).where("k > 1").select("i", "m"))
    mark = sha256(F.coalesce(F.col(text), F.lit("")))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(doc_id).alias("di"), mark.alias("dm"))
    on = F.col("i").eqNullSafe(F.col("di")) & (F.col("m") == F.col("dm"))
    left = src.join(cut_lineage(lost), on, "left_anti")
    if not ties.isEmpty():
        one = left.join(ties, on, "left_semi").groupBy("di", "dm").agg(F.first("r").alias("r"))
        left = left.join(ties, on, "left_anti").select("r").unionByName(one.select("r"))
    return left.select("r.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
