"""Nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .common import table

#: The index is fitted on so many rows; every row is then indexed.
FIT_ROWS = 8192
#: Rows that fill a partition, and rows of the sample that a partition needs.
PART_ROWS, LEAST_SAMPLE = 640, 128
#: Neighbours of a row in the graph.
DEGREE = 16
#: Rows whose true neighbours among all rows set how much probability is probed.
JUDGES, RECALL = 256, 0.96
#: Rows of a partition, and queries, that one task compares at a time.
BLOCK, QUERY_BLOCK = 8192, 2048


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row the ``degree`` others with the largest inner product."""
    out = np.empty((len(x), degree), np.int64)
    for lo in range(0, len(x), 1024):
        near = x[lo:lo + 1024] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def _halve(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of the graph with edges (a, b): which nodes are on the upper
    side. The second eigenvector of the random walk orders the nodes, its middle
    cuts them, and swaps of one node of each side then lower the cut."""
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1).astype(float)
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        pull = np.bincount(a, v[b], n) + np.bincount(b, v[a], n)
        v = 0.5 * v + 0.5 * pull / degree
        v /= np.abs(v).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n - n // 2:]] = True
    for _ in range(20):
        cut = (side[a] != side[b]) * 2.0 - 1
        gain = np.bincount(a, cut, n) + np.bincount(b, cut, n)
        up, down = np.flatnonzero(~side), np.flatnonzero(side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        m = min(len(up), len(down))
        better = np.flatnonzero(gain[up[:m]] + gain[down[:m]] > 0)
        m = (len(better) + 1) // 2  # neighbours that both move would undo each other
        if not m:
            break
        trial = side.copy()
        trial[up[:m]], trial[down[:m]] = True, False
        if (trial[a] != trial[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = trial
    return side


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each node: the graph is halved until there are ``parts``, a power of two."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    part = np.zeros(n, np.int64)
    while parts > 1:
        new = np.zeros(n, np.int64)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            inside = (part[a] == p) & (part[b] == p)
            new[mine] = _halve(place[a[inside]], place[b[inside]], len(mine), rng)
        part = part * 2 + new
        parts //= 2
    return part


@dataclass
class Router:
    """A small classifier: the probability of each partition for a vector."""

    scale: float
    layers: list[tuple[np.ndarray, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return np.maximum(x * self.scale @ w1 + b1, 0) @ w2 + b2

    def shares(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, wanted: np.ndarray, rng: np.random.Generator, hidden: int = 128, rounds: int = 30, batch: int = 256) -> Router:
    """Cross entropy against the shares of a row's neighbours in each partition, by Adam."""
    dim, parts = x.shape[1], wanted.shape[1]
    scale = 1 / max(np.sqrt((x * x).sum(axis=1)).mean(), 1e-30)
    router = Router(scale, [(rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden)), (rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts))])
    flat = [p for layer in router.layers for p in layer]
    m1, m2, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    for r in range(rounds):
        rate = 4e-3 * (1 - r / rounds) + 1e-4
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo:lo + batch]
            inner = x[at] * scale
            h = np.maximum(inner @ flat[0] + flat[1], 0)
            z = h @ flat[2] + flat[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            back = (z / z.sum(axis=1, keepdims=True) - wanted[at]) / len(at)
            down = (back @ flat[2].T) * (h > 0)
            t += 1
            for p, g, u, v in zip(flat, (inner.T @ down, down.sum(axis=0), h.T @ back, back.sum(axis=0)), m1, m2, strict=True):
                g = g + 1e-4 * p
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return router


@dataclass
class Index:
    """What routes vectors of length ``dim``: without a router there is one partition."""

    dim: int
    router: Router | None
    mass: float = 1.0  # probability that is probed
    sample: np.ndarray | None = None
    sample_ids: list | None = None

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), np.int64) if self.router is None else self.router.logits(x).argmax(axis=1)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions by falling probability, and the probability before each."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        shares = self.router.shares(x)
        order = np.argsort(-shares, axis=1, kind="stable")
        sorted_ = np.take_along_axis(shares, order, axis=1)
        return order, np.cumsum(sorted_, axis=1) - sorted_

    def probes(self, x: np.ndarray) -> list[list[int]]:
        order, before = self.ranked(x)
        return [o[b < self.mass].tolist() for o, b in zip(order, before, strict=True)]

    def floors(self, x: np.ndarray, ids: list, probed: list[list[int]], k: int) -> list[float]:
        """A score that the ``k`` nearest found of each query reach: that of the
        k-th among the rows of the sample in its partitions. Rows below it need
        not leave their task."""
        if self.router is None or not len(x):
            return [-np.inf] * len(x)
        part, out = self.parts(self.sample), []
        at: dict = {}
        for j, i in enumerate(self.sample_ids):
            at.setdefault(i, []).append(j)
        for lo in range(0, len(x), 256):
            rough = x[lo:lo + 256] @ self.sample.T
            for row, i, mine in zip(rough, ids[lo:lo + 256], probed[lo:lo + 256], strict=True):
                row[at.get(i, [])] = -np.inf
                row = row[np.isin(part, mine)]
                out.append(float(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else -np.inf)
        return out


def _stack(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_of(queries: np.ndarray, query_ids: list, rows: np.ndarray, row_ids: list, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
    """(query, row, score) of the ``k`` nearest rows of each query that have
    another id and reach its floor; all rows that tie with the last, to rounding.
    Scores are summed in one fixed order, so that equal vectors have equal scores."""
    rough = queries @ rows.T
    own: dict = {}
    for j, i in enumerate(row_ids):
        own.setdefault(i, []).append(j)
    for q, i in enumerate(query_ids):
        rough[q, own.get(i, [])] = -np.inf
    slack = 1e-9 * np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1)).max(initial=0)
    for q in range(len(queries)):
        last = np.partition(rough[q], len(row_ids) - k)[len(row_ids) - k] if len(row_ids) > k else -np.inf
        last = last if floors is None else max(last, floors[q])
        found = np.flatnonzero((rough[q] >= last - slack[q]) & (rough[q] > -np.inf))
        for j, s in zip(found.tolist(), (rows[found] * queries[q]).sum(axis=1).tolist(), strict=True):
            yield q, j, s


def _valid(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as arrays of doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(v.isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0)))


def _true_neighbours(rows: DataFrame, judges: np.ndarray, judge_ids: list, k: int) -> np.ndarray:
    """The nearest ``k`` of all rows of each judge, as vectors: one pass over the rows,
    in which a task keeps the best of each batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_pylist()
                found = list(nearest_of(judges, judge_ids, _stack(batch.column(1)), ids, k))
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                    batch.column(0).take(pa.array([f[1] for f in found], pa.int64())), batch.column(1).take(pa.array([f[1] for f in found], pa.int64()))],
                    names=["judge", "score", "vec_id", "v"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = rows.mapInArrow(work, f"judge bigint, score double, vec_id {kind}, v array<double>")
    rank = F.row_number().over(W.partitionBy("judge").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("judge", "v").collect()  # JUDGES * k rows
    return np.array([r.judge for r in best], np.int64), np.array([r.v for r in best], float)


def fit(rows: DataFrame, dim: int, n: int, k: int) -> Index:
    """An index for ``rows`` (vec_id, v), which have ``n`` vectors of length ``dim``.

    The sample, FIT_ROWS rows with the smallest hashes, makes the graph, its
    partitions and the classifier on the driver. How much probability a search
    probes is then measured, not assumed: JUDGES rows of the sample, kept from
    the classifier, are compared with all rows, and the smallest mass with which
    their true neighbours are found to RECALL is taken.
    """
    parts = 1
    while parts * 2 * PART_ROWS <= n * 1.42 and parts * 2 * LEAST_SAMPLE <= FIT_ROWS:
        parts *= 2
    if parts == 1:
        return Index(dim, None)
    mine = rows.where(F.size("v") == dim)
    sample = mine.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(FIT_ROWS).collect()
    ids, x = [r.vec_id for r in sample], np.array([r.v for r in sample], float)
    rng = np.random.default_rng(0)
    judged = min(JUDGES, len(x) // 8)
    near = neighbour_graph(x, min(DEGREE, len(x) - 1))
    part = balanced_parts(near, parts, rng)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / (near.shape[1] + 1))
    wanted[np.arange(len(x)), part] += 1 / (near.shape[1] + 1)  # its own part as well
    index = Index(dim, train(x[judged:], wanted[judged:], rng), sample=x, sample_ids=ids)
    of, found = _true_neighbours(mine, x[:judged], ids[:judged], k)
    if len(of):
        order, before = index.ranked(x[:judged])
        place = np.argsort(order, axis=1)
        need = before[of, place[of, index.parts(found)]]
        index.mass = float(np.nextafter(np.sort(need)[int(np.ceil(RECALL * len(need))) - 1], 2))
    return index


def search(rows: DataFrame, is_query: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found of each row of ``rows`` for which ``is_query``
    (a condition on a column ``vec_id``) holds: query_id, rank, vec_id, score.

    Nearness is the inner product of the vectors in double precision, equal ones
    by smaller id, null ids last. Rows with the id of the query are never its
    neighbours. Vectors that are null, zero, or hold a null or a number that is
    not finite take no part; vectors of different length never meet. Repeated
    rows are one query, and neighbours each for itself; a table without vectors
    gives no rows; columns other than the two are not read.

    All rows are indexed by the partition that a classifier gives them, and a
    query goes to its most probable partitions until their probability reaches
    the fitted mass. Only the most frequent length has a classifier; vectors of
    other lengths, and small tables, are compared in full. Rows that the sample
    already shows to be too far from a query don't leave their task. A partition is
    compared in blocks of rows and queries, so a large one is many tasks. Of
    equal vectors only the k + 1 with the smallest ids can be in a result, so
    the rest does not join; a vector that a third of all rows share costs k + 1 rows.
    """
    src = _valid(rows, vec_id, vector)
    copy = F.row_number().over(W.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))
    kept = src.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    asked = src.where(is_query).distinct()
    both = cut_lineage(kept.withColumn("asks", F.lit(False)).union(asked.withColumn("asks", F.lit(True))))
    lengths = both.where(~F.col("asks")).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        kind = src.schema["vec_id"].dataType.simpleString()
        return src.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index = fit(both.where(~F.col("asks")).drop("asks"), lengths["dim"], lengths["count"], k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            parts, floors = [[0]] * batch.num_rows, [-np.inf] * batch.num_rows
            own = np.flatnonzero((sizes == index.dim) & ~asks)
            if len(own):
                for i, p in zip(own, index.parts(_stack(batch.column(1).take(pa.array(own)))).tolist(), strict=True):
                    parts[i] = [p]
            own = np.flatnonzero((sizes == index.dim) & asks)
            if len(own):
                x = _stack(batch.column(1).take(pa.array(own)))
                probed = index.probes(x)
                for i, p, f in zip(own, probed, index.floors(x, batch.column(0).take(pa.array(own)).to_pylist(), probed, k), strict=True):
                    parts[i], floors[i] = p, f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32())), pa.array(floors, pa.float64())], names=[*batch.schema.names, "parts", "least"])

    kind = both.schema["vec_id"].dataType.simpleString()
    placed = both.mapInArrow(place, f"vec_id {kind}, v array<double>, asks boolean, parts array<int>, least double")
    placed = cut_lineage(placed.select("vec_id", "v", "asks", "least", F.explode("parts").alias("part"), F.size("v").alias("dim")))
    blocks = lambda n, size: F.greatest(F.ceil(F.sum(n) / F.lit(size)), F.lit(1)).cast("int")
    sizes = cut_lineage(placed.groupBy("dim", "part").agg(
        blocks((~F.col("asks")).cast("int"), BLOCK).alias("row_blocks"), blocks(F.col("asks").cast("int"), QUERY_BLOCK).alias("query_blocks")))
    placed = placed.join(sizes, ["dim", "part"])
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Both sides get columns of their own, or a join of them would be ambiguous.
    side = lambda rows, rb, qb, to: rows.select(F.struct("dim", "part", rb.alias("rb"), qb.alias("qb")).alias(to), F.col("vec_id").alias(f"{to}_id"), F.col("v").alias(f"{to}_v"), "least")
    left = placed.where("asks").withColumn("rb", every("row_blocks"))
    left = side(left, F.col("rb"), deal("query_blocks"), "q")
    right = placed.where("not asks").withColumn("qb", every("query_blocks"))
    right = side(right, deal("row_blocks"), F.col("qb"), "r").drop("least")

    def compare(queries: pa.Table, others: pa.Table) -> pa.Table:
        column = lambda t, name: t.column(name).combine_chunks()
        q_ids, r_ids = column(queries, "q_id"), column(others, "r_id")
        found = []
        if len(q_ids) and len(r_ids):
            found = list(nearest_of(_stack(column(queries, "q_v")), q_ids.to_pylist(), _stack(column(others, "r_v")), r_ids.to_pylist(), k, column(queries, "least").to_numpy()))
        take = lambda a, i: a.take(pa.array([f[i] for f in found], pa.int64()))
        return pa.table({"query_id": take(q_ids, 0), "mark": take(column(queries, "mark"), 0), "vec_id": take(r_ids, 1), "score": pa.array([f[2] for f in found], pa.float64())})

    left = left.withColumn("mark", F.xxhash64("q_v"))  # tells vectors of one id apart
    found = left.groupBy("q").cogroup(right.groupBy("r")).applyInArrow(compare, f"query_id {kind}, mark bigint, vec_id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
