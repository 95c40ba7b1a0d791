"""Periodic runs, conversation repair and learned partitions against their plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sungrid.llm import ann_partitions, conversation_repair, periodic_runs

SMALL = "/root/testdata/sf0.001"
CLASHES = ["t", "runs", "collapsed", "c", "s", "first", "said", "copies", "seen", "salt", "of", "v", "part", "dim", "rb", "qb", "mark", "rank", "score", "query_id", "asks", "copy", "n", "b", "kind", "audit"]


def clashing(df):
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES if c not in df.columns]).repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


# --- periodic runs


@pytest.mark.parametrize("least", [12, 7, 5, 4, 2])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 3, 4, 6, 50]), rng.choice([0, 5, 12, 20, 40, 80, 200])
            ws = [b"w%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
            texts.append(ws)
        for ws, found in zip(texts, periodic_runs.find_runs(texts, least), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute.runs(ws, least)


def test_grammar_gives_back_its_words_and_repeats_no_pair():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randrange(1, 80)
        ids = [rng.randrange(3) for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), min(2, n - 1))) if n > 1 else []
        nodes, starts = periodic_runs.replace_pairs(ids, cuts)
        for _, start, mid, end in nodes:
            assert start < mid < end and not any(start < c < end for c in cuts)
        by = {}
        for symbol, start, _, end in nodes:  # equal symbols derive equal words
            assert by.setdefault(symbol, ids[start:end]) == ids[start:end]
        size = {}
        for symbol, start, _, end in nodes:
            size[start] = (symbol, end)
        left = [size.get(s, (("word", ids[s]), s + 1)) for s in starts]
        assert sum(e - s for (_, e), s in zip(left, starts, strict=True)) == n
        pairs = {}
        for i in range(len(starts) - 1):
            if starts[i + 1] not in cuts:
                pairs.setdefault((left[i][0], left[i + 1][0]), []).append(i)
        for where in pairs.values():
            assert len(where) < 2 or (len(where) == 2 and where[1] == where[0] + 1)  # places that overlap


def test_runs_of_awkward_texts(spark, tmp_path):
    rng = random.Random(2)
    words = "the of and to in ÉTÉ straße kilo lima mike \U0001F600".split()
    rows = [(i, " ".join(rng.choice(words[: rng.choice([2, 4, 11])]) for _ in range(rng.choice([1, 11, 30, 60, 200])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 20), (None, None), (203, "x " * 40), (203, "x " * 40), (204, "\x1c\x1c a\x0bb\x0ca\rb " * 9)]
    rows += [(205, " ".join(words[i % 5] for i in range(3000))), (206, "    " * 15)]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic_runs.op13_periodic_runs(spark, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    assert ordered(got) == ordered(brute.periodic(rows))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    none = clashing(spark.createDataFrame([], "doc_id long, text string"))
    assert periodic_runs.periodic_runs(none).count() == 0


def test_runs_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len((r[1] or "").split()) < 1500]  # the plain version is quadratic
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SMALL).join(ids, "doc_id").collect()]
    assert ordered(got) == ordered(brute.periodic(rows)) and any(r[1] for r in got)


# --- conversation repair


def test_cells_against_all_edits():
    rng = random.Random(4)
    for _ in range(250):
        turns = [(rng.choice("suaut "), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        turns = [(who, gone, cut and not gone) for who, gone, cut in turns]
        chart = conversation_repair.Chart()
        for who, gone, cut in turns:
            chart.add(conversation_repair.turn_cells(who, gone, cut, 1))
        got = conversation_repair.cheapest(chart.cells())
        assert got == brute.every_repair(turns)[:2] == brute.cheapest_repair(turns)[:2]


def test_every_split_gives_the_same_cells():
    """The full chart, all spans and all splits, against the spans that are filled."""
    rng = random.Random(6)
    for n in (1, 2, 3, 5, 8, 13):
        turns = [conversation_repair.turn_cells(rng.choice("sua "), rng.random() < 0.2, rng.random() < 0.2, rng.choice([1, 1, 3])) for _ in range(n)]
        full = {(i, i + 1): turns[i] for i in range(n)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                made = [conversation_repair.joined(full[i, k], full[k, i + length]) for k in range(i + 1, i + length)]
                assert all(m == made[0] for m in made)
                full[i, i + length] = made[0]
        chart = conversation_repair.Chart()
        for t in turns:
            chart.add(t)
        assert chart.cells() == full[0, n]


def _turns(rng, conv, n, faults=0.3):
    rows = []
    for t in range(n):
        role = rng.choice(["system", "user", "assistant", "tool", None, ""]) if rng.random() < faults else "user" if t % 2 == 0 else "assistant"
        text = rng.choice(["Yes.", "No", "", " \t", None, "Why?", "long " * 50 + ".", "ÄÖ  "]) if rng.random() < 2 * faults else f"text {t}."
        rows.append((conv, rng.randrange(n) if rng.random() < faults else t, role, text))
    return rows


def test_conversations_against_plain_repair(spark, tmp_path):
    rng = random.Random(8)
    rows = [r for c in range(80) for r in _turns(rng, c, rng.randrange(1, 12))]
    rows += _turns(rng, 1000, 300) + [(1001, None, "user", "Hm."), (1001, 4, "user", "Hm."), (1001, None, None, None)] + _turns(rng, None, 6)
    rows += [(1002, 3, "user", "Same.")] * 7 + [(1003, t, "user", "Again.") for t in range(40)] + [(1004, 2**62, "user", "Far."), (1004, 1, "system", "Near.")]
    clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in conversation_repair.op11_conversation_repair(spark, str(tmp_path)).collect()]
    assert ordered(got) == ordered(brute.conversations(rows))


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    """Sorted partitions cut a long conversation, wherever they like."""
    rng = random.Random(9)
    rows = [r for c, n in ((1, 400), (2, 3), (3, 120)) for r in _turns(rng, c, n, 0.1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = [tuple(r) for r in conversation_repair.repaired(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered(got) == ordered(brute.conversations(rows))


def test_conversations_of_the_small_table_and_of_none(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in conversation_repair.op11_conversation_repair(spark, SMALL).collect()]
    assert ordered(got) == ordered(brute.conversations(rows))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(conversation_repair.damaged(none)).count() == 0


# --- learned partitions


def close(got, want):
    got, want = ordered(got), ordered(want)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_search_of_few_and_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)]  # many ties
    rows += [(200 + i, [1.0, 2.0, 0.0, 1.0, 0.0, -1.0]) for i in range(60)]  # copies
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (420, []), (440, [1.0, 2.0]), (441, [3.0, 1.0]), (None, [1.0] * 6)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in ann_partitions.search(df, F.col("vec_id") % 20 == 0, k=5).collect()]
    close(got, brute.nearest(rows, 5))
    assert ann_partitions.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = [tuple(r) for r in ann_partitions.search(df.where("vec_id < 4"), F.col("vec_id") % 20 == 0).collect()]
    close(few, brute.nearest(rows[:4], 20))


def test_repeated_rows_are_one_query_and_many_neighbours(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [1.0, 1.0])] * 2 + [(2, [2.0, 0.0])]
    got = [tuple(r) for r in ann_partitions.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=20).collect()]
    assert ordered(got) == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0)]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 4000)] + 0.6 * rng.standard_normal((4000, 24))
    x[3000:3500] = x[17]  # a vector that many rows share
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)


@pytest.mark.parametrize("block", [8192, 150])
def test_recall_of_learned_partitions(spark, clustered, monkeypatch, block):
    rows, df = clustered
    monkeypatch.setattr(ann_partitions, "BLOCK", block)
    monkeypatch.setattr(ann_partitions, "QUERY_BLOCK", block // 4)
    monkeypatch.setattr(ann_partitions, "FIT_ROWS", 1024)
    found = [tuple(r) for r in ann_partitions.search(df, F.col("vec_id") % 20 == 0).collect()]
    want = {(q, v): s for q, _, v, s in brute.nearest(rows, 20)}
    assert len(found) == len(want)
    assert sum((q, v) in want for q, _, v, _ in found) >= 0.9 * len(want)
    for q, _, v, s in found:
        assert abs(s - float((np.array(rows[q][1]) * np.array(rows[v][1])).sum())) < 1e-12
    by = {}
    for q, r, v, s in sorted(found):
        assert r == by.get(q, (0, None))[0] + 1 and (by.get(q) is None or (-by[q][1][0], by[q][1][1]) < (-s, v))
        by[q] = (r, (s, v))


def test_parts_of_the_graph_are_balanced_and_follow_it():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(8) * 5, 100, axis=0) + 0.3 * rng.standard_normal((800, 8))
    near = ann_partitions.neighbour_graph(x, 10)
    assert all((near[i] // 100 == i // 100).all() for i in range(0, 800, 37))
    part = ann_partitions.balanced_parts(near, 8, rng)
    assert np.bincount(part).tolist() == [100] * 8
    assert (part[near] == part[:, None]).mean() > 0.9


def test_search_of_the_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in ann_partitions.op12_learned_partitions(spark, SMALL).collect()}
    want = {(q, v) for q, _, v, _ in brute.nearest(rows, 20)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
