"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage
from .common import fold, rows_of, table, words

#: Labelled rows that the lexicon and the weights are fitted on, at most.
SAMPLE = 20_000
#: A lexicon entry stands in at least LEAST_TEXTS distinct toxic texts of the sample, and in clean ones at most CLEAN_SHARE times as often.
LEAST_TEXTS, CLEAN_SHARE = 5, 0.05
#: It covers LEAST_TEXTS toxic texts that no other entry does, or LEAST_NEW if it is one of FREQUENT texts.
FREQUENT, LEAST_NEW = 20, 2
STEMS = range(3, 9)  # lengths of word beginnings, in characters

# Closed-class words of the grammar.
THREAT = "kill hurt destroy beat burn shoot stab murder matar golpear tuer frapper schlagen umbringen".split()
PROMISE = "mataré mataremos golpearé golpearemos tuerai tuerons frapperai frapperons".split()  # a threat's verb in the future
INTENT = "will i'll we'll he'll they'll shall gonna going voy vamos vas vais allons werde werden wird".split()
TARGET = "you your yours yourself they them tú usted ustedes vosotros toi vous ton votre du dich dein ihr euch".split()
OBJECT = "te os dich euch vous".split()  # may stand before its verb
NEGATION = "not never isn't aren't wasn't don't doesn't nunca jamás jamais kein keine niemals nicht".split()
REPORTED = "said says say claimed called quoted wrote reported dijo dice llamó dit disait appelé sagte sagt nannte".split()
MENTION = "word words term palabra término mot terme wort begriff".split()

_SCAN = re.compile(rb"[0-9a-z\x80-\xff]+(?:'[a-z]+)?|[.!?;:,\n]")
_ENDS, _BREAKS = frozenset(b".!?;\n"), frozenset(b":,")
#: What a matched clause can be, in the order of the model's columns.
PATTERNS = ("insult", "insult at target", "negated insult", "reported insult", "threat", "threat at target", "negated threat", "reported threat")
#: How a kind of clause counts before any label is seen, relative to a plain insult.
PRIOR = (1.0, 1.3, 0.5, 0.5, 0.5, 1.0, 0.2, 0.2)


@dataclass
class Transducer:
    """A deterministic transducer: (state, symbol) -> (symbol, state). A symbol
    without an arc passes unchanged and goes to ``idle`` of its state."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    idle: dict[str, str] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol)) or (symbol, self.idle.get(state, state))

    def then(self, other: Transducer, symbols: str) -> Transducer:
        """The composition: what this one writes is what ``other`` reads."""
        made, todo = Transducer(f"{self.start}/{other.start}"), [(self.start, other.start)]
        seen = set(todo)
        while todo:
            a, b = todo.pop()
            for x in symbols:
                y, a2 = self.step(a, x)
                z, b2 = other.step(b, y)
                made.arcs[f"{a}/{b}", x] = (z, f"{a2}/{b2}")
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return made


#: Input symbols: I word of the lexicon, V verb of a threat, W the same as a promise, F intent, Y target, O target
#: as an object, N negation, R reported speech, M mention, "," break in a clause, "." end of a clause, o other.
SYMBOLS = "IVWFYONRM,.o"


def insult() -> Transducer:
    """A word of the lexicon is an insult (I), unless it is named as a word: "the word ..." (r)."""
    return Transducer("i0", {("i0", "M"): ("o", "i1"), ("i1", "M"): ("o", "i1"), ("i1", "I"): ("r", "i0")}, {"i1": "i0"})


def threat() -> Transducer:
    """A verb alone is none. H: a promise, or a verb within three words of an intent;
    K: a verb next to its object, which is the target too."""
    t = Transducer("h0", idle={"h3": "h2", "h2": "h1", "h1": "h0", "v": "h0", "p": "h0"})
    for s in ("h0", "h1", "h2", "h3", "v", "p"):
        t.arcs |= {(s, "F"): ("o", "h3"), (s, "V"): ("o", "v"), (s, "W"): ("H", "h0"), (s, "O"): ("O", "p"), (s, ","): (",", "h0"), (s, "."): (".", "h0")}
    for s in ("h1", "h2", "h3"):
        t.arcs[s, "V"] = ("H", "h0")
    t.arcs |= {("h3", "O"): ("O", "h2"), ("h2", "O"): ("O", "h1"), ("v", "Y"): ("K", "h0"), ("v", "O"): ("K", "h0"), ("p", "V"): ("K", "h0")}
    return t


def negation() -> Transducer:
    """Reaches three words on (i, h, k), twice is none; as the last word before a
    break (c) or the end (x) it reaches back to the break before."""
    t = Transducer("n0", {("n0", "N"): ("o", "n3")}, {"n3": "n2", "n2": "n1", "n1": "n0"})
    for s, left in t.idle.items():
        t.arcs |= {(s, "I"): ("i", left), (s, "H"): ("h", left), (s, "K"): ("k", left), (s, "N"): ("o", "n0"), (s, ","): (",", "n0"), (s, "."): (".", "n0")}
    t.arcs |= {("n3", ","): ("c", "n0"), ("n3", "."): ("x", "n0")}
    return t


def target() -> Transducer:
    """A target anywhere in a clause marks its end (T; X if that negates)."""
    t = Transducer("t0")
    for s in ("t0", "t1"):
        t.arcs |= {(s, "Y"): ("o", "t1"), (s, "O"): ("o", "t1"), (s, "K"): ("H", "t1"), (s, "k"): ("h", "t1")}
    t.arcs |= {("t0", "x"): ("x", "t0"), ("t1", "."): ("T", "t0"), ("t1", "x"): ("X", "t0")}
    return t


def reported() -> Transducer:
    """Reported speech anywhere in a clause marks its end (Q), whatever else does."""
    t = Transducer("r0", {("r0", "R"): ("o", "r1"), ("r1", "R"): ("o", "r1")})
    t.arcs |= {("r1", end): ("Q", "r0") for end in ".xTX"}
    return t


def grammar() -> Transducer:
    """Insults, threats, negation, targets and reported speech, composed.

    Writes I, H plain and i, h negated matches, r mentioned ones, "," and c at
    breaks, and at the end of a clause one of ".xTXQ" for how it is to be read.
    """
    made, read = insult(), SYMBOLS
    for t in (threat(), negation(), target(), reported()):
        made = made.then(t, read)
    return made


#: A clause's matches I i r H h as they count at its end, by what the end says.
_HITS = {x: i for i, x in enumerate("IirHh")}
_READ = {".": (0, 2, 3, 4, 6), "x": (0, 2, 3, 4, 6), "T": (1, 2, 3, 5, 6), "X": (1, 2, 3, 5, 6), "Q": (3, 3, 3, 7, 7)}


class Matcher:
    """The grammar with a lexicon in front: word -> symbol and weight. A threat
    weighs as the middle entry of the lexicon, 1 if that is empty."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole: dict[bytes, float] = {k[1:].encode(): w for k, w in lexicon.items() if k[0] == "="}
        self.stems: dict[bytes, float] = {k[1:].encode(): w for k, w in lexicon.items() if k[0] == "^"}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        closed = (TARGET, OBJECT, NEGATION, REPORTED, MENTION, INTENT, THREAT, PROMISE)
        self.closed = {w.encode(): x for x, ws in zip("YONRMFVW", closed, strict=True) for w in ws}
        self.threats = {w.encode() for w in THREAT + PROMISE}
        self.threat = sorted(lexicon.values())[len(lexicon) // 2] if lexicon else 1.0
        made = grammar()
        self.arcs, self.start = made.arcs, made.start

    def weight(self, w: bytes) -> float:
        if w in self.whole:
            return self.whole[w]
        for n in self.lengths:
            if len(w) >= n and w[:n] in self.stems:
                return self.stems[w[:n]]
        return 0.0

    def clauses(self, text: bytes | None) -> np.ndarray:
        """Per kind of clause, the summed weights of the matches of a text. A clause
        is read to its end before its matches count; the end of the text is one."""
        found = [0.0] * len(PATTERNS)
        distinct = set(words(text))
        insults = {w: x for w in distinct if (x := self.weight(w))}
        if not insults and self.threats.isdisjoint(distinct):
            return np.array(found)
        state, part, clause = self.start, [0.0] * len(_HITS), [0.0] * len(_HITS)
        for w in (*_SCAN.findall(text.lower()), b"."):
            x = insults.get(w, 0.0)
            symbol = "I" if x else "." if w[0] in _ENDS else "," if w[0] in _BREAKS else self.closed.get(w, "o")
            out, state = self.arcs[state, symbol]
            if out in _HITS:
                part[_HITS[out]] += x or self.threat
            elif out in ",cxX.TQ":
                if out in "cxX":
                    part = [0.0, part[0] + part[1], part[2], 0.0, part[3] + part[4]]
                clause, part = [a + b for a, b in zip(clause, part)], [0.0] * len(_HITS)
                if out in _READ:
                    for kind, weight in zip(_READ[out], clause):
                        found[kind] += weight
                    clause = [0.0] * len(_HITS)
        return np.array(found)


def _features(text: bytes) -> set[str]:
    out = set()
    for w in set(words(text)):
        s = w.decode("utf-8", "replace")
        out.add("=" + s)
        out.update("^" + s[:n] for n in STEMS if n < len(s))
    return out


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(t, y): at most ``most`` labelled texts, by a hash of the id; equal texts once."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & (fold("i", 5) != 0))
    known = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most)
    src = docs.select(F.col(doc_id).alias("di"), F.col(text).alias("t")).where("t is not null")
    met = src.join(F.broadcast(known), F.col("di") == F.col("i"))  # most rows of two numbers at most
    return met.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("h")).agg(F.min(F.struct("y", F.col("t").cast("binary").alias("t"))).alias("r")).select("r.t", "r.y")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by label; flushed when many."""
    def out(c: Counter) -> pa.RecordBatch:
        keys = sorted({k for k, _ in c})
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([c[k, 1] for k in keys], pa.int64()), pa.array([c[k, 0] for k in keys], pa.int64())], names=["f", "bad", "good"])

    seen: Counter = Counter()
    for batch in rows_of(batches):
        for t, y in zip(batch.column(0), batch.column(1), strict=True):
            y = int(y.as_py() > 0)
            seen.update((f, y) for f in _features(t.as_py()))
            if len(seen) > 200_000:
                yield out(seen)
                seen.clear()
    if seen:
        yield out(seen)


def _cover(sets: list[list[int]], size: list[int]) -> list[int]:
    """Entries that cover the toxic texts: always the one in most texts not yet
    covered, the longer one of equals."""
    by: dict[int, set[int]] = {}
    for i, fs in enumerate(sets):
        for f in fs:
            by.setdefault(f, set()).add(i)
    least = {f: LEAST_NEW if len(s) >= FREQUENT else LEAST_TEXTS for f, s in by.items()}
    chosen = []
    while by:
        f = max(by, key=lambda f: (len(by[f]), size[f], -f))
        if len(by[f]) < least[f]:
            del by[f]
            continue
        chosen.append(f)
        gone = by.pop(f)
        for g in [g for g, s in by.items() if not s.isdisjoint(gone)]:
            by[g] = by[g] - gone
            if len(by[g]) < least[g]:
                del by[g]
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of the clause kinds and an intercept, by Newton steps.

    All kinds share one scale, times PRIOR; each may leave it by a penalised
    difference, so that a kind without evidence follows the others.
    """
    x = np.hstack((x @ np.array(PRIOR)[:, None], x, np.ones((len(x), 1))))
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], 10.0)
    pull[[0, -1]] = 1e-2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return [*(w[0] * np.array(PRIOR) + w[1:-1]), w[-1]]


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A lexicon and the weights of clause kinds, from at most ``sample`` labelled
    texts whose crc32(doc_id) mod 5 is not 0.

    Lexicon: words and beginnings of words that toxic texts share and clean ones
    lack, chosen so that each covers toxic texts that the others do not; a text
    and its copies count once. Of several labels of an id the largest counts, of
    those of equal texts the smallest. Without labels of both kinds the lexicon is
    empty.
    """
    rows = cut_lineage(_sample(docs, labels, doc_id, text, label, sample))
    bad, good = rows.agg(F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("y") <= 0).cast("long")), F.lit(0))).first()
    if not bad or not good:
        return Model({}, [*PRIOR, np.log((bad + 0.5) / (good + 0.5)) - 1.0])
    counted = rows.mapInArrow(_counts, "f string, bad bigint, good bigint").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    likely = counted.where((F.col("bad") >= LEAST_TEXTS) & (F.col("good") <= F.col("bad") * CLEAN_SHARE)).collect()  # of a bounded sample
    likely.sort(key=lambda r: r.f)
    number = {r.f: i for i, r in enumerate(likely)}
    sent = rows.sparkSession.sparkContext.broadcast(number)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(known[f] for f in _features(t.as_py()) if f in known) for t in batch.column(0)], pa.list_(pa.int64()))], names=["fs"])

    sets = [r.fs for r in rows.where("y > 0").select("t").mapInArrow(candidates, "fs array<bigint>").toLocalIterator()]
    # a whole word counts as longer than its beginnings
    chosen = _cover(sets, [2 * len(r.f) + (r.f[0] == "=") for r in likely])
    odds = np.log((bad + 0.5) / (good + 0.5))
    lexicon = {likely[f].f: float(np.log((likely[f].bad + 0.5) / (likely[f].good + 0.5)) - odds) for f in chosen}
    found = rows.mapInArrow(_matcher(rows.sparkSession, lexicon), "y int, x array<double>").toLocalIterator()
    y, x = zip(*[(float(r.y > 0), r.x) for r in found])
    return Model(lexicon, [float(w) for w in _logistic(np.array(x), np.array(y))])


def _matcher(spark: SparkSession, lexicon: dict[str, float]):
    sent = spark.sparkContext.broadcast(lexicon)  # an entry covers texts of the sample that no other does: fewer than those

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Matcher(sent.value)
        for batch in rows_of(batches):
            x = [made.clauses(t.as_py()).tolist() for t in batch.column(batch.schema.get_field_index("t"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, n in enumerate(batch.schema.names) if n != "t"], pa.array(x, pa.list_(pa.float64()))], names=[*[n for n in batch.schema.names if n != "t"], "x"])

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, clauses (weights by PATTERNS)
    and a struct ``kept`` of the ``keep`` columns.

    Null and empty texts match nothing and score as any clean text. Null ids count
    as empty ids in the split. Repeated rows are scored each; no rows give none.
    """
    held = fold(doc_id, 5) == 0
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("one"))
    src = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), kept.alias("kept"), F.col(text).cast("binary").alias("t"))
    schema = src.drop("t").schema.add("x", T.ArrayType(T.DoubleType()))
    got = src.mapInArrow(_matcher(docs.sparkSession, model.lexicon), schema)
    z = sum((F.col("x")[i] * w for i, w in enumerate(model.weights[:-1])), F.lit(model.weights[-1]))
    p = 1 / (1 + F.exp(-z))
    return got.select("doc_id", "held_out", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), F.col("x").alias("clauses"), "kept")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not judged toxic, with all their columns and in
    their order, whatever their names. Null and empty texts and repeated rows stay as
    clean ones do; no rows give none."""
    return score(docs, fit(docs, labels), keep=docs.columns).where("predicted = 0").select("kept.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("clauses", "kept")
