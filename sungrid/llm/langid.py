"""Language by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, rows_of, table

#: n-grams of characters, hashed into so many buckets.
SIZES, BUCKETS = (1, 2, 3), 1 << 16
#: Labelled texts that the weights are fitted on, at most; of these every fifth calibrates.
SAMPLE = 6_000
#: The regularised leader: learning rate, smoothing, L1 and L2 weights; passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-5, 3
#: n-grams of a long text are counted by so many beginnings at a time.
PIECE = 1 << 18


def _codes(text: str) -> np.ndarray:
    """Buckets of the n-grams that begin at one of the first PIECE characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, out = np.zeros(len(c), np.uint64), []
    for n in range(1, max(SIZES) + 1):  # an n-gram's hash goes on from that of its beginning
        if len(c) < n:
            break
        h = (h[:len(c) - n + 1] ^ c[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            out.append((h[:PIECE] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and term frequencies (shares of all n-grams) of a whole text,
    lower-cased, with a blank at each end. A long text is counted in pieces, each
    with the characters behind it that its last n-grams reach into."""
    text = f" {text.lower()} "
    if len(text) < 500:
        at, n = np.unique(_codes(text), return_counts=True)
    else:
        counts, reach = np.zeros(BUCKETS, np.int64), PIECE + max(SIZES) - 1
        for i in range(0, len(text), PIECE):
            counts += np.bincount(_codes(text[i:i + reach]), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        n = counts[at]
    return at, n / n.sum()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages, times the inverse document frequency
    idf: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequency(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows of ``docs``; and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in rows_of(batches):
            for t in batch.column(0).to_pylist():
                n += 1
                df[features(t)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["b", "n"])

    got = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    df = np.zeros(BUCKETS, np.int64)
    total = 0
    for r in got:
        if r.b < 0:
            total = r.n
        else:
            df[r.b] = r.n
    return df, total


class Ftrl:
    """Follow the regularised leader, per coordinate, for a multinomial logistic
    regression with L1 and L2 penalties; weights are exactly zero where the
    gradients' sum stays within the L1 penalty."""

    def __init__(self, buckets: int, classes: int):
        self.z = np.zeros((buckets + 1, classes))
        self.n = np.zeros((buckets + 1, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Scales logits so that the likelihood of held-back rows is largest (golden section on its log)."""
    def loss(t: float) -> float:
        p = _softmax(z / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Weights from at most ``sample`` texts with a language, chosen by a hash of
    the id; document frequencies from every text that may be learned from, which
    are those whose crc32(doc_id) mod 4 is not 2. Every fifth of them sets the
    temperature and teaches no weights; of fewer than 50, all do both. None where no
    text has a language."""
    src = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("y")).where((fold(doc_id, 4) != 2) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    df, total = document_frequency(src, text="t")
    idf = np.log((1 + total) / (1 + df)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            made = [features(t) for t in batch.column(0).to_pylist()]
            packed = [pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*packed, batch.column(1)], names=["at", "x", "y"])

    picked = src.select("i").orderBy(F.xxhash64("i"), "i").limit(sample).distinct()  # ids alone are sorted
    chosen = src.join(F.broadcast(picked), "i").groupBy(F.sha2(F.col("t").cast("binary"), 256)).agg(F.min(F.struct("i", "t", "y")).alias("r")).orderBy(F.xxhash64("r.i"), "r.i").limit(sample)
    rows = []
    for r in chosen.select("r.t", "r.y").mapInArrow(run, "at binary, x binary, y string").toLocalIterator():
        at, x = np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32)
        x = x * idf[at]
        rows.append((at, (x / np.sqrt((x * x).sum())).astype(np.float32), r.y))
    if not rows:
        return None
    langs = sorted({y for _, _, y in rows})
    number = {y: k for k, y in enumerate(langs)}
    rows = [(at, x, number[y]) for at, x, y in rows]
    held = rows[::5] if len(rows) >= 50 else rows
    learn = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    made, order = Ftrl(BUCKETS, len(langs)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(learn)):
            made.learn(*learn[i])
    w = made.weights(slice(None))
    z = np.array([x @ w[at] + w[-1] for at, x, _ in held])
    return Model(langs, w[:-1] * idf[:, None], idf, w[-1], _temperature(z, np.array([y for _, _, y in held])) if len(langs) > 1 else 1.0)


def predict(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the calibrated probability).

    ``und`` with score 0 where the text is null or has no letter, or where no
    language could be learned. Of equally likely languages the first in the order
    of their names is taken. Every character of a text counts, however long.
    Null ids count as empty ids in the split. Repeated rows are judged each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in rows_of(batches):
            langs, scores = [], []
            for t in batch.column(2).to_pylist():
                if m is None or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at, tf = features(t)
                norm = np.sqrt(((tf * m.idf[at]) ** 2).sum())
                p = _softmax((tf @ m.weights[at] / norm + m.bias) / m.temperature)
                k = int(p.argmax())
                langs.append(m.langs[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, 4) == 2).alias("held_out"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
