"""A causal self-attention language model over subwords, trained and run in numpy."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import fold, rows_of, table

#: A file of ranked byte merges; the driver reads it and sends it to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Subwords with an embedding of their own; width; classes of the output, in a grid of PARTS rows.
SLOTS, DIM, CLASSES, PARTS = 1024, 16, 64, 8
FINE = CLASSES // PARTS
#: Tokens that a window scores, and tokens of context before them.
HALF = 16
#: Every training text trains the attention weights, in one of ROUNDS of averaging.
ROUNDS, RATE, BATCH = 4, 0.02, 64
#: Words whose counts every task holds; the counts of the others are joined.
HEAD = 100_000
NEAR = 32  # buckets for the neighbours of a subword
CHUNK = 64  # windows that are scored at once; what they need stays in a cache


class Subwords:
    """The subword ids of words, each with a blank before it; two bytes an id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.core = tiktoken.Encoding("own", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.begins = begin_words(ranks)

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids; and of each word where in them its own begin and how many they are.
        The empty word is the end of a text. No word has a blank inside, so that all
        can be told apart in one text, by the ids that begin with a blank."""
        ids = np.array(self.core.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.uint16)
        real = np.fromiter(map(len, words), np.int64, len(words)) > 0
        first, long = np.full(len(words), len(ids)), np.ones(len(words), np.int64)
        first[real] = np.flatnonzero(self.begins[ids])
        long[real] = np.diff(np.append(first[real], len(ids)))
        return np.append(ids, np.uint16(len(self.begins) - 1)), first, long


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def begin_words(ranks: dict[bytes, int]) -> np.ndarray:
    """Whether an id begins a word, as it has the blank; the last id is the end."""
    begins = np.ones(max(ranks.values()) + 2, bool)
    for b, i in ranks.items():
        begins[i] = b[:1] == b" "
    return begins


def split_texts(texts: pa.Array) -> pa.ListArray:
    """The words of each text (bytes), as ``common.tokens`` gives them, besides which
    a text has empty ones where it begins or ends with white space. Arrow's ASCII
    functions look at single bytes, whether or not these are UTF-8."""
    texts = texts.cast(pa.binary())
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.StringArray.from_buffers(len(texts), *texts.buffers()[1:], offset=texts.offset)))


def _bytes(words: pa.Array) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(words), words.buffers(), offset=words.offset)


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): every token of the training texts (columns t and held_out) with its
    count over all of them; the end of a text is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in rows_of(batches, 8 << 20):
            ends += batch.num_rows
            words, times = pc.value_counts(split_texts(batch.column(0)).flatten()).flatten()
            real = pc.greater(pc.binary_length(words), 0)
            yield pa.RecordBatch.from_arrays([_bytes(words.filter(real)), times.filter(real)], names=["w", "c"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["w", "c"])

    return docs.where("not held_out").select("t").mapInArrow(run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def known_words(counts: DataFrame, ranks: dict[bytes, int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The HEAD most frequent words, their counts, and their ids as ``Subwords.each`` gives them."""
    most = counts.orderBy(F.desc("c"), "w").limit(HEAD).toArrow().combine_chunks()
    words = most.column("w").combine_chunks().cast(pa.binary())
    return words, most.column("c").to_numpy(), *Subwords(ranks).each(words.to_pylist())


def encoded(docs: DataFrame, ranks, common, whole: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, held_out, t): a number, the ids of its text, and
    what its words known to all tasks (``common``, from ``known_words``) give; the
    other words as w with their times k. A word is looked up once in a batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Subwords(ranks.value)
        head, counts, *stock = common.value
        share = np.append(np.log10((counts + 1) / whole), 0)  # below zero, as whole > c + 1; the last: not known to all
        uid = TaskContext.get().partitionId() << 33
        for batch in rows_of(batches):
            n, split = batch.num_rows, split_texts(batch.column(2))
            # The end of a text is the empty word; where white space gives one, it is dropped.
            coded = pa.concat_arrays([split.flatten(), pa.array([""])]).dictionary_encode()
            code, words = coded.indices.to_numpy(), _bytes(coded.dictionary)
            code, end = code[:-1], code[-1]
            row = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
            real = code != end
            row = row[real]
            size = np.bincount(row, minlength=n) + 1
            last = np.cumsum(size) - 1
            word = np.full(size.sum(), end)
            word[np.arange(len(row)) + row] = code[real]
            at = pc.index_in(words, head).fill_null(len(head)).to_numpy()
            new = np.flatnonzero(at == len(head))
            fresh = made.each(words.take(pa.array(new)).to_pylist())
            ids, begin, long = np.append(stock[0], fresh[0]), *(x.take(at, mode="clip") for x in stock[1:])
            begin[new], long[new] = fresh[1] + len(stock[0]), fresh[2]
            each = long[word]
            to = np.cumsum(each)
            ids = ids[np.arange(to[-1]) + np.repeat(begin[word] - to + each, each)]
            at = at[word]
            first = last - size + 1
            base, known = np.add.reduceat(share[at], first), np.add.reduceat((at < len(head)).astype(np.int64), first)
            other = np.flatnonzero(at == len(head))
            pair, times = np.unique(np.searchsorted(last, other) * len(words) + word[other], return_counts=True)
            upto = np.append(0, np.cumsum(np.bincount(pair // len(words), minlength=n))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(upto, x) for x in (words.take(pa.array(pair % len(words))), pa.array(times, pa.int64())))
            bounds = np.append(0, 2 * to[last]).astype(np.int32)
            texts = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), batch.column(0), batch.column(1), *map(pa.array, (size, known, base)), texts, *lists],
                                             names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "w", "k"])
            uid += n

    return docs.mapInArrow(run, f"uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, ids binary, w array<binary>, k array<bigint>")


def subword_counts(coded: DataFrame, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Per subword id its count in all training texts, and its counts of bucketed
    neighbours to the left and right within words. Sums of one row per id and
    task; the result has a row per id of the vocabulary at most."""
    begins = begin_words(ranks)
    size = len(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((size, 1 + 2 * NEAR))
        for batch in rows_of(batches):
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).astype(np.int64)
            inner = np.flatnonzero(~begins[flat])
            left, right = flat[inner - 1], flat[inner]
            near[:, 0] += np.bincount(flat, minlength=size)
            near[:, 1:1 + NEAR] += np.bincount(right * NEAR + left % NEAR, minlength=size * NEAR).reshape(size, NEAR)
            near[:, 1 + NEAR:] += np.bincount(left * NEAR + right % NEAR, minlength=size * NEAR).reshape(size, NEAR)
        yield _rows(near)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((size, 1 + 2 * NEAR))
        for batch in batches:
            np.add.at(near, batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()).reshape(-1, 1 + 2 * NEAR))
        yield _rows(near)

    def _rows(near: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(near[:, 0])
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(near[at]), pa.list_(pa.float64()))], names=["id", "n"])

    kind = "id bigint, n array<double>"
    near = np.zeros((size, 1 + 2 * NEAR))
    for r in coded.where("not held_out").select("ids").mapInArrow(run, kind).repartition(16, "id").mapInArrow(add, kind).toLocalIterator():
        near[r.id] = r.n
    return near[:, 0], near[:, 1:]


@dataclass
class Vocabulary:
    slot: np.ndarray  # id -> embedding row; the rare share the last but one, padding has the last
    group: np.ndarray  # id -> class of the output
    within: np.ndarray  # id -> log probability within its class


def vocabulary(counts: np.ndarray, near: np.ndarray) -> Vocabulary:
    """Slots for the most frequent ids; classes of ids with alike neighbours, by
    spherical k-means, laid out in a grid by the two directions of their largest
    spread; add-one shares within a class."""
    order = np.lexsort((np.arange(len(counts)), -counts))[:SLOTS - 1]
    order = order[counts[order] > 0]
    slot = np.full(len(counts), SLOTS - 1)
    slot[order] = np.arange(len(order))
    group = np.full(len(counts), CLASSES - 1)
    if len(order):
        x = np.sqrt(near[order] + 1e-3)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        weight = counts[order]
        k = min(CLASSES - 1, len(order))
        centres = x[:k].copy()  # the most frequent ids
        for _ in range(20):
            mine = np.argmax(x @ centres.T, axis=1)
            for j in range(k):
                if (mine == j).any():
                    c = (x[mine == j] * weight[mine == j, None]).sum(axis=0)
                    centres[j] = c / np.linalg.norm(c)
        spread = centres - centres.mean(axis=0)
        along = spread @ np.linalg.svd(spread, full_matrices=False)[2][:2].T
        row = np.argsort(np.argsort(along[:, 0])) // FINE
        group[order] = np.argsort(np.lexsort((along[:, -1], row)))[mine]
    total, size = np.bincount(group, counts, CLASSES), np.bincount(group, minlength=CLASSES)
    return Vocabulary(slot, group, np.log((counts + 1) / np.maximum(total + size, 1)[group]))


def windows(ids: list[np.ndarray], v: Vocabulary, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of texts: rows of 2 * HALF input slots, HALF target ids
    (-1 behind the end), and the text of each row. The inputs of a row's second
    half predict its targets; its first half is context, the inputs before. So
    every token is a target once, and sees at least HALF tokens where there are."""
    n = np.array([len(x) for x in ids])
    per = -(-n // HALF)
    fill = np.full(HALF, -1)
    targets = np.concatenate([part for x, k in zip(ids, (-n % HALF).tolist(), strict=True) for part in (x, fill[:k])], dtype=np.int64, casting="unsafe")
    begins = np.cumsum(per) - per
    slots = np.empty(len(targets) + 1, np.int64)
    np.take(v.slot, targets, out=slots[1:], mode="wrap")
    slots = slots[:-1]
    slots[begins * HALF] = v.slot[end]  # a text begins behind an end
    slots[targets < 0] = SLOTS  # padding
    targets, slots = targets.reshape(-1, HALF), slots.reshape(-1, HALF)
    win = np.empty((len(slots), 2 * HALF), np.int64)
    win[:, HALF:], win[1:, :HALF], win[begins, :HALF] = slots, slots[:-1], SLOTS
    return win, targets, np.repeat(np.arange(len(ids)), per)


_SHAPES = {"emb": (SLOTS, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "far": (HALF, 2 * HALF), "out": (DIM, PARTS + FINE), "bias": (PARTS + CLASSES,)}
#: Input j may be seen from the i-th of the second half: causal.
_CAUSAL = np.arange(2 * HALF)[None, :] <= np.arange(HALF)[:, None] + HALF


def start(v: Vocabulary, counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    p = {k: rng.normal(0, 0.25, s).astype(np.float32) for k, s in _SHAPES.items()}
    p["far"] *= 0
    held = np.bincount(v.group, counts + 1e-3, CLASSES).reshape(PARTS, FINE) + 1e-9  # a class without subwords has next to no share
    part = held.sum(axis=1, keepdims=True)
    p["bias"] = np.log(np.concatenate(((part / part.sum()).ravel(), (held / part).ravel()))).astype(np.float32)
    return p


#: Per class, ones at its row of the grid; and at where its two stand among the logits.
_ROW = np.repeat(np.eye(PARTS, dtype=np.float32), FINE, axis=0)
_BOTH = np.hstack((_ROW, np.tile(np.eye(FINE, dtype=np.float32), (PARTS, 1))))
#: Adds the exponentials of the rows, and those of the columns, to each of their places.
_SUMS = np.kron(np.eye(2, dtype=np.float32), np.ones((FINE, FINE), np.float32))
_SPREAD = np.ones((2 * HALF, DIM), np.float32)
assert PARTS == FINE


def _slots(win: np.ndarray) -> np.ndarray:
    """The inputs of windows that follow each other, each once. What one has as
    second half is the next one's first, unless a text begins there; that half is
    hidden. Padding stands behind all real inputs, so that no real target sees it,
    and is taken for the last slot (by clipping)."""
    slots = np.empty((len(win) + 1, HALF), win.dtype)
    slots[0], slots[1:] = win[0, :HALF], win[:, HALF:]
    return slots.ravel()


def _weigh(e: np.ndarray, far: np.ndarray, win: np.ndarray) -> None:
    """What each target gives to each input, before the division by their sum, in
    place of the products of queries and keys."""
    np.exp(e, out=e)
    e *= far
    e[np.flatnonzero(win[:, 0] == SLOTS), :, :HALF] = 0  # a text begins: the half before is another's


def _bound(x: np.ndarray) -> None:
    if x.max() > 60 or x.min() < -60:
        np.clip(x, -60, 60, out=x)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Rows of all inputs (HALF of context, then HALF a window) as both halves of each window."""
    row, one = x.strides
    return np.ndarray((len(x) // HALF - 1, 2 * HALF, x.shape[1]), x.dtype, x, strides=(HALF * row, row, one))


def _logits(out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A matrix that gives the logits of the grid's rows and, as (DIM + row)-th entry
    is 1 for the target's row, of its columns. A class has the probability of its
    row times that of its column in the row."""
    made = np.empty((DIM + PARTS, PARTS + FINE), out.dtype)
    made[:DIM], made[DIM:, :PARTS], made[DIM:, PARTS:] = out, bias[:PARTS], bias[PARTS:].reshape(PARTS, FINE)
    return made


class Scorer:
    """The forward pass, with what depends on a slot alone looked up in a table."""

    def __init__(self, p: dict[str, np.ndarray]):
        emb = p["emb"]
        q, k = emb @ p["q"] / math.sqrt(DIM), emb @ p["k"]
        q *= min(1.0, 60 / max(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max(), 1e-9))
        self.table = np.hstack((emb, q, k, emb @ p["v"])).astype(np.float32)
        self.far = (np.exp(p["far"]) * _CAUSAL).astype(np.float32)
        self.logits = _logits(p["out"], p["bias"]).astype(np.float32)

    def log_classes(self, win: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Log probability of the class of each target: of its part, times that of the
        class in the part. Windows as they follow each other in their texts."""
        made, group = self.table.take(_slots(win), axis=0, mode="clip"), group.ravel()
        here, both = made[HALF:], _pairs(made)
        e = here[:, DIM:2 * DIM].reshape(-1, HALF, DIM) @ both[..., 2 * DIM:3 * DIM].transpose(0, 2, 1)
        _weigh(e, self.far, win)
        mixed = (e @ both[..., 3 * DIM:]).reshape(-1, DIM)
        mixed /= e.reshape(-1, 2 * HALF) @ _SPREAD + 1e-9
        h = np.empty((len(here), DIM + PARTS), np.float32)
        np.add(here[:, :DIM], mixed, out=h[:, :DIM])
        h[:, DIM:] = _ROW.take(group, axis=0)
        y = h @ self.logits
        _bound(y)
        picked = np.einsum("ij,ij->i", y, _BOTH.take(group, axis=0))
        np.exp(y, out=y)
        total = (y.reshape(-1, FINE) @ _SUMS[0, :FINE]).reshape(-1, 2)
        return (picked - np.log(total[:, 0] * total[:, 1])).reshape(-1, HALF)


def loss_and_gradients(p: dict[str, np.ndarray], win: np.ndarray, group: np.ndarray, real: np.ndarray, into: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over real targets and its gradients, by hand; with ``into`` these
    are written there, and there is no loss. Windows are given as they follow each
    other in their texts, so keys and values are computed once. The layout keeps
    what is next to each other in memory next to each other in the products."""
    kind, n_win, group = p["emb"].dtype, len(win), group.ravel()
    slots = _slots(win)
    x = p["emb"].take(slots, axis=0, mode="clip")
    weights = np.empty((DIM, 3 * DIM), kind)
    weights[:, :DIM], weights[:, DIM:2 * DIM], weights[:, 2 * DIM:] = p["q"] / math.sqrt(DIM), p["k"], p["v"]
    made = x @ weights
    both = _pairs(made)
    q, k, v = made[HALF:, :DIM].reshape(n_win, HALF, DIM), both[..., DIM:2 * DIM], both[..., 2 * DIM:]
    e = q @ k.transpose(0, 2, 1)
    _bound(e)
    _weigh(e, np.exp(p["far"]) * _CAUSAL, win)
    below = e.reshape(-1, 2 * HALF) @ _SPREAD.astype(kind, copy=False)
    mixed = (e @ v).reshape(-1, DIM)
    mixed /= below
    h = np.empty((n_win * HALF, DIM + PARTS), kind)
    np.add(x[HALF:], mixed, out=h[:, :DIM])
    h[:, DIM:] = _ROW.take(group, axis=0)
    logits = _logits(p["out"], p["bias"])
    y = h @ logits
    _bound(y)
    np.exp(y, out=y)
    y /= y @ _SUMS.astype(kind, copy=False)
    is_target = _BOTH.take(group, axis=0)
    n, fake = max(1, np.count_nonzero(real)), np.flatnonzero(~real.ravel())
    loss = math.nan
    if into is None:
        into = {k: np.empty(s, kind) for k, s in _SHAPES.items()}
        loss = -((np.log(y + 1e-30) * is_target).sum(axis=1) @ real.ravel()) / n
    y -= is_target
    y[fake] = 0
    y *= kind.type(1 / n)
    grad = h.T @ y
    into["out"][:] = grad[:DIM]
    into["bias"][:PARTS], into["bias"][PARTS:] = grad[DIM:, :PARTS].sum(axis=0), grad[DIM:, PARTS:].ravel()
    dh = y @ logits[:DIM].T
    do = dh / below
    mixed *= do
    ds = do.reshape(n_win, HALF, DIM) @ v.transpose(0, 2, 1)
    ds -= (mixed @ _SPREAD[:DIM, 0].astype(kind, copy=False)).reshape(n_win, HALF, 1)
    ds *= e
    np.matmul(np.ones(n_win, kind), ds.reshape(n_win, -1), out=into["far"].reshape(-1))
    pairs = np.empty((n_win, 2 * HALF, 2 * DIM), kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=pairs[..., :DIM])
    np.matmul(e.transpose(0, 2, 1), do.reshape(n_win, HALF, DIM), out=pairs[..., DIM:])
    back = np.empty((n_win + 1, HALF, 3 * DIM), kind)  # of queries, keys and values
    back[0, :, :DIM] = 0
    np.matmul(ds, k, out=back[1:, :, :DIM])
    np.add(pairs[:-1, HALF:], pairs[1:, :HALF], out=back[1:-1, :, DIM:])
    back[0, :, DIM:], back[-1, :, DIM:] = pairs[0, :HALF], pairs[-1, HALF:]
    back = back.reshape(-1, 3 * DIM)
    grad = x.T @ back
    np.divide(grad[:, :DIM], math.sqrt(DIM), out=into["q"])
    into["k"][:], into["v"][:] = grad[:, DIM:2 * DIM], grad[:, 2 * DIM:]
    dx = back @ weights.T
    dx[HALF:] += dh
    into["emb"][:] = 0
    np.add.at(into["emb"].reshape(-1), _CELLS.take(slots, axis=0, mode="clip").ravel(), dx.ravel())
    return float(loss), into


_CELLS = np.arange(SLOTS * DIM).reshape(SLOTS, DIM)


class Adam:
    """Steps on the weights ``w``, a flat array, in place; ``rate`` is the step's size."""

    def __init__(self, w: np.ndarray, rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.gradient, self.mean, self.square, self.by = np.zeros((4, len(w)), w.dtype)

    def update(self) -> None:
        """A step against ``gradient``, which it uses up. Both averages are kept
        without the factors (0.1 and 0.01) of what they add."""
        g, by = self.gradient, self.by
        self.step += 1
        self.mean *= 0.9
        self.mean += g
        g *= g
        self.square *= 0.99
        self.square += g
        np.multiply(self.square, 0.01 / (1 - 0.99 ** self.step), out=by)
        np.sqrt(by, out=by)
        by += 1e-8
        np.divide(self.mean, by, out=by)
        by *= 0.1 * self.rate / (1 - 0.9 ** self.step)
        self.w -= by


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name; parts of ``flat`` itself where it is of their type."""
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


def train(coded: DataFrame, end: int, shared, p: dict[str, np.ndarray], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of local steps (Adam) on the windows of each partition of ``coded``
    (columns doc_id and ids) from the same weights, then their mean weighted by
    windows. Texts are dealt to the rounds by their ids, and each trains once; its
    windows are made where they are used. Partitions' weights are summed in 16
    streams; the driver sees 16 sets of weights."""
    for r in range(rounds):
        sent = coded.sparkSession.sparkContext.broadcast(_flat(p))
        rate = RATE * (1 - r / rounds)

        def local(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            v = shared.value
            w, seen = sent.value.copy(), 0
            p, adam = _shaped(w), Adam(w, rate)
            g = _shaped(adam.gradient)
            for batch in rows_of(batches, 1 << 20):
                win, targets, _ = windows([np.frombuffer(t.as_py(), np.uint16) for t in batch.column(0)], v, end)
                real, group = targets >= 0, v.group.take(targets, mode="wrap")
                for at in np.random.default_rng(len(win)).permutation(np.arange(0, len(win), BATCH)):
                    pick = slice(at, at + BATCH)
                    loss_and_gradients(p, win[pick], group[pick], real[pick], g)
                    adam.update()
                seen += len(win)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64) * seen], pa.list_(pa.float64())), pa.array([seen], pa.int64())], names=["p", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for x, k in zip(batch.column(0), batch.column(1), strict=True):
                    x = x.values.to_numpy()
                    total, n = (x.copy() if total is None else total + x), n + k.as_py()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["p", "n"])

        kind = "p array<double>, n bigint"
        dealt = coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("ids")
        got = dealt.mapInArrow(local, kind).repartition(16).mapInArrow(add, kind).collect()
        if got:
            p = _shaped(sum(np.array(x.p) for x in got) / sum(x.n for x in got))
    return p


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary_file: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts whose crc32(doc_id) mod 7 is not 2: counts of words and
    subwords and the attention weights, each from all of them. score is the model's log10 probability of the subwords
    of the whole text and its end: of their classes by attention over the last
    HALF to 2 * HALF - 1 subwords, times their shares within the class.

    The SLOTS - 1 most frequent subwords have an embedding each; all others share
    one, and their class, and differ by their shares within it.

    Null and empty texts are an end alone. Null ids count as empty ids in the
    split. Repeated rows are scored each. Without training texts the counts are
    zero and the weights stay as drawn; no rows give none. A text is one unit of
    work: its ids and windows are in one task at once. Texts are turned into ids
    once, in a written table that training and scoring read.

    Counts of the HEAD most frequent words are sent to the tasks, the others are
    joined with (text, word, times) rows, of which a word brings one per text.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, 7) == 2).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    merges = read_ranks(vocabulary_file)
    ranks, end = spark.sparkContext.broadcast(merges), max(merges.values()) + 1
    counts = cut_lineage(word_counts(src))
    n, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    whole = n + types + 1
    head = spark.sparkContext.broadcast(known_words(counts, merges))
    coded = cut_lineage(encoded(src, ranks, head, whole))
    sub, near = subword_counts(coded, merges)
    v = vocabulary(sub, near)
    shared = spark.sparkContext.broadcast(v)
    weights = spark.sparkContext.broadcast(train(coded.where("not held_out"), end, shared, start(v, sub)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, scorer = shared.value, Scorer(weights.value)
        for batch in rows_of(batches, 1 << 20):
            win, targets, owner = windows([np.frombuffer(t.as_py(), np.uint16) for t in batch.column(batch.num_columns - 1)], v, end)
            score = np.zeros(batch.num_rows)
            for lo in range(0, len(win), CHUNK):
                t = targets[lo:lo + CHUNK]
                lp = scorer.log_classes(win[lo:lo + CHUNK], v.group.take(t, mode="wrap")) + v.within.take(t, mode="wrap")
                score += np.bincount(owner[lo:lo + CHUNK], np.where(t >= 0, lp, 0).sum(axis=1), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score / math.log(10))], names=[*batch.schema.names[:-1], "score"])

    texts = coded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids")
    scored = texts.mapInArrow(run, texts.drop("ids").schema.add("score", "double"))
    rest = coded.select("uid", F.explode(F.arrays_zip("w", "k")).alias("r")).select("uid", F.col("r.w").alias("w"), F.col("r.k").alias("k"))
    met = rest.join(counts.hint("merge"), "w", "left")
    more = met.select("uid", F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(whole)))).alias("base"))
    by = scored.unionByName(more, allowMissingColumns=True).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.max("score").alias("score"))
    return by.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
