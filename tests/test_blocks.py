"""Block-wise windows against plain pandas, with blocks small enough to be many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sungrid.operators import blocks, grid, joins, model, ranks, splits, stats, windows

START = pd.Timestamp("2024-01-01")


def frame(spark, n=400, seed=3, hot=True):
    """Irregular unique times of two series, one of them far larger, with gaps."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, rows in (("hot", n), ("small", n // 10)):
        at = np.sort(rng.choice(5_000_000, rows, replace=False))
        v = np.where(rng.random(rows) < 0.4, np.nan, rng.integers(0, 50, rows).astype(float))
        parts.append(pd.DataFrame({"series_id": name, "ts": START + pd.to_timedelta(at, unit="s"), "v": v}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).select("series_id", F.col("ts").cast("timestamp_ntz"), F.nanvl("v", F.lit(None).cast("double")).alias("v"))
    return pdf, df


def collected(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("block_s", [3_600, 86_400, 86_400 * 365])
def test_row_index_previous_and_running(spark, block_s):
    pdf, df = frame(spark)
    out = blocks.row_index(df, key=["series_id"], ts="ts", block_s=block_s, total="n")
    out = blocks.previous_row(out, key=["series_id"], ts="ts", cols={"v": "before"}, block_s=block_s)
    out = blocks.running_sum(out, key=["series_id"], ts="ts", cols={"v": "total"}, block_s=block_s)
    got = collected(out, "series_id", "ts")
    want = pdf.sort_values(["series_id", "ts"]).reset_index(drop=True)
    by = want.groupby("series_id")
    assert (got.rn == by.cumcount()).all()
    assert (got.n == by.v.transform("size")).all()
    pd.testing.assert_series_equal(got.before, by.v.shift(1), check_names=False)
    pd.testing.assert_series_equal(got.total, want.v.fillna(0).groupby(want.series_id).cumsum(), check_names=False)


@pytest.mark.parametrize("block_s", [3_600, 86_400 * 3])
def test_fill_reaches_over_blocks(spark, block_s):
    pdf, df = frame(spark)
    got = collected(grid.fill_edges(df, key=["series_id"], ts="ts", cols=["v"], block_s=block_s), "series_id", "ts")
    want = pdf.sort_values(["series_id", "ts"]).groupby("series_id").v.transform(lambda s: s.ffill().bfill()).reset_index(drop=True)
    pd.testing.assert_series_equal(got.v, want, check_names=False)


@pytest.mark.parametrize("block_s", [7_200, 86_400 * 30])
def test_reindex_nearest_is_pandas_nearest(spark, block_s):
    pdf, df = frame(spark)
    known = pdf.dropna()
    got = collected(grid.reindex_nearest(df.where("v is not null"), key=["series_id"], ts="ts", cols=["v"], step_s=3600, block_s=block_s), "series_id", "ts")
    for name, part in known.groupby("series_id"):
        mine = got[got.series_id == name].set_index("ts").v
        assert mine.index.min() == part.ts.min().floor("h") and mine.index.max() == part.ts.max().ceil("h")
        want = part.set_index("ts").v.reindex(mine.index, method="nearest")
        assert (mine == want).all()


def test_reindex_tie_takes_the_later(spark):
    rows = [("a", "2024-01-01 00:30:00", 1.0), ("a", "2024-01-01 01:30:00", 2.0)]
    df = spark.createDataFrame(rows, "series_id string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = collected(grid.reindex_nearest(df, key=["series_id"], ts="ts", cols=["v"], step_s=3600), "ts")
    assert got.v.tolist() == [1.0, 2.0, 2.0]  # 01:00 lies between both
    near = collected(grid.reindex_nearest(df, key=["series_id"], ts="ts", cols=["v"], step_s=3600, tolerance_s=1200), "ts")
    assert near.v.isna().all()


def test_reading_on_a_grid_time_counts_from_both_sides(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 5.0), ("a", "2024-01-01 02:00:00", 7.0)]
    df = spark.createDataFrame(rows, "series_id string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert collected(grid.reindex_nearest(df, key=["series_id"], ts="ts", cols=["v"], step_s=3600, block_s=3600), "ts").v.tolist() == [1.0, 5.0, 7.0]
    up = collected(grid.upsample_linear(df, key=["series_id"], ts="ts", cols=["v"], step_s=1800, block_s=3600), "ts")
    assert up.v.tolist() == [1.0, 3.0, 5.0, 6.0, 7.0]


def test_row_windows_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.random(100)
    pdf = pd.DataFrame({"series_id": "a", "i": np.arange(100) - 37, "v": v, "w": rng.random(100)})
    df = spark.createDataFrame(pdf)
    got = collected(windows.rolling(df, key=["series_id"], index="i", col="v", n=7, rows=8), "i")
    np.testing.assert_allclose(got.v_mean, pdf.v.rolling(7).mean())
    np.testing.assert_allclose(got.v_std, pdf.v.rolling(7).std())
    r = collected(windows.rolling_corr(df, key=["series_id"], index="i", a="v", b="w", n=9, rows=8), "i")
    np.testing.assert_allclose(r["corr"], pdf.v.rolling(9).corr(pdf.w))


def test_sequence_counts_and_targets(spark):
    df = spark.range(50).select(F.lit("a").alias("series_id"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("y"))
    n = 6
    both = {}
    for step in (True, False):
        both[step] = collected(windows.sequences(df, key=["series_id"], index="i", ts="ts", features=["y"], target="y", n=n, next_step=step, rows=8), "target_ts")
    assert len(both[True]) == 50 - n and len(both[False]) == 50 - n + 1
    for k, row in both[True].iterrows():
        assert [x["y"] for x in row.x] == list(range(k, k + n)) and row.y == k + n
    assert both[False].y.tolist() == list(range(n - 1, 50))


def test_last_rows(spark):
    pdf, df = frame(spark)
    got = collected(joins.last_rows(df, key=["series_id"], ts="ts", n=15, block_s=7_200), "series_id", "ts")
    want = pdf.sort_values("ts").groupby("series_id").tail(15).sort_values(["series_id", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got.astype({"ts": "datetime64[ns]"}), want.astype({"ts": "datetime64[ns]"}))


def test_block_seconds_follows_the_densest_stretch(spark):
    _, df = frame(spark)
    narrow = blocks.block_seconds(df, key=["series_id"], ts="ts", rows=10)
    assert 1 <= narrow < blocks.block_seconds(df, key=["series_id"], ts="ts", rows=200)


@pytest.mark.parametrize("bucket_rows", [7, 10**6])
def test_ranks_and_quantiles_with_many_ties(spark, bucket_rows):
    rng = np.random.default_rng(5)
    v = np.where(rng.random(900) < 0.35, 0.0, np.round(rng.lognormal(1, 2, 900), 1))  # a third of one value
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.8, "hot", "small"), "v": v})
    df = spark.createDataFrame(pdf)
    got = ranks.value_ranks(df, value="v", group=["g"], bits=5, bucket_rows=bucket_rows, distinct=True).toPandas()
    for name, part in pdf.groupby("g"):
        mine = got[got.g == name].sort_values("v")
        counts = part.v.value_counts().sort_index()
        assert mine.v.tolist() == counts.index.tolist() and mine.cnt.tolist() == counts.tolist()
        assert mine.less.tolist() == [0, *counts.cumsum().tolist()[:-1]]
        assert mine.distinct_less.tolist() == list(range(len(counts))) and (mine.n == len(part)).all()
    q = ranks.quantiles(df, value="v", group=["g"], probs={"a": 0.1, "b": 0.5, "c": 0.93}, bucket_rows=bucket_rows).toPandas().set_index("g")
    for name, part in pdf.groupby("g"):
        np.testing.assert_allclose(q.loc[name, ["a", "b", "c"]].astype(float), np.percentile(part.v, [10, 50, 93]))


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, 150).astype(float)
    pdf = pd.DataFrame({"g": "a", "x": x, "y": np.round(x / 3 + rng.integers(0, 4, 150))})
    sx, sy = (np.sign(pdf[c].values[:, None] - pdf[c].values[None, :]) for c in "xy")
    want = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
    got = ranks.kendall_tau(spark.createDataFrame(pdf), group=["g"], x="x", y="y", rows=4, bucket_rows=20).first()
    assert got["n"] == 150 and abs(got["tau"] - want) < 1e-12


def test_kendall_of_all_pairs_of_columns(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.where(rng.random(240) < 0.8, "a", "b"), "x": rng.random(240), "y": rng.integers(0, 5, 240).astype(float), "same": 1.0})
    pdf["z"] = np.where(rng.random(240) < 0.4, 0.0, pdf.x + rng.random(240))
    df = spark.createDataFrame(pdf).select("k", *[F.when(F.rand(1) < 2, F.col(c)).alias(c) for c in ("x", "y", "z", "same")])
    got = {(r.k, r.a, r.b): r for r in ranks.kendall_matrix(df, group=["k"], cols=["x", "y", "z", "same"], rows=16, bucket_rows=30).collect()}
    for k, part in pdf.groupby("k"):
        signs = {c: np.sign(part[c].values[:, None] - part[c].values) for c in ("x", "y", "z")}
        for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
            want = (signs[a] * signs[b]).sum() / np.sqrt((signs[a] ** 2).sum() * (signs[b] ** 2).sum())
            assert got[k, a, b].n == len(part) and abs(got[k, a, b].tau - want) < 1e-12
        assert got[k, "x", "same"].tau is None
    assert len(got) == 12


def test_rolling_keeps_digits_and_constant_windows(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate((np.full(30, 0.1), 1e9 + rng.random(40), np.full(20, 1e9 + 0.1), rng.random(30) * 1e-6, [np.nan], rng.random(20)))
    pdf = pd.DataFrame({"k": "a", "i": np.arange(len(v)) - 11, "v": v, "w": rng.random(len(v))})
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    for n, rows in ((7, 8), (7, 500), (12, 16), (2, 4), (1, 4)):
        got = collected(windows.rolling(df, key=["k"], index="i", col="v", n=n, rows=rows), "i")
        for j in range(len(v)):
            part = v[j - n + 1:j + 1] if j >= n - 1 else np.array([np.nan])
            if np.isnan(part).any():
                assert np.isnan(got.v_mean[j]) and np.isnan(got.v_std[j])
            elif part.min() == part.max():
                assert got.v_mean[j] == part[0] and (got.v_std[j] == 0 if n > 1 else np.isnan(got.v_std[j]))
            else:
                centre = part - part.min()
                assert abs(got.v_mean[j] - part.min() - centre.mean()) <= 4e-16 * abs(part).max()
                assert got.v_std[j] == pytest.approx(centre.std(ddof=1), rel=1e-6)
    r = collected(windows.rolling_corr(df, key=["k"], index="i", a="v", b="w", n=9, rows=16), "i")["corr"]
    assert np.isnan(r[29]) and np.isnan(r[85]) and r[60] == pytest.approx(np.corrcoef(v[52:61] - 1e9, pdf.w[52:61])[0, 1], rel=1e-6)


def test_lags_longer_than_a_block_and_of_short_series(spark):
    rng = np.random.default_rng(7)
    parts = [pd.DataFrame({"k": k, "i": np.arange(n), "v": rng.random(n)}) for k, n in (("a", 90), ("b", 5))]
    got = stats.autocorrelation(spark.createDataFrame(pd.concat(parts)), key=["k"], index="i", value="v", lags=40, rows=8).toPandas().set_index(["k", "lag"]).acf
    for p in parts:
        d = p.v.to_numpy() - p.v.mean()
        for k in range(1, 41):
            assert got[p.k[0], k] == pytest.approx((d[k:] * d[:-k]).sum() / (d * d).sum() if k < len(d) else 0, abs=1e-12)


def test_autocorrelation_and_decomposition(spark):
    rng = np.random.default_rng(2)
    v = np.sin(np.arange(120) * 2 * np.pi / 7) + rng.normal(0, 0.1, 120)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(120), "ts": START + pd.to_timedelta(np.arange(120), "D"), "v": v})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    acf = collected(stats.autocorrelation(df, key=["k"], index="i", value="v", lags=10, rows=16), "lag")
    d = v - v.mean()
    np.testing.assert_allclose(acf.acf, [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 11)])
    parts = collected(stats.seasonal_decompose(df, key=["k"], index="i", ts="ts", value="v", period=7, rows=16), "ts")
    np.testing.assert_allclose(parts.trend, pd.Series(v).rolling(7, center=True).mean())
    assert parts.trend.isna().sum() == 6 and abs(parts.seasonal.iloc[:7].sum()) < 1e-9


def test_missing_series_and_times_keep_their_rows(spark):
    rows = [(None, f"2024-01-0{d} 00:00:00", float(d)) for d in (1, 2, 3)] + [("a", "2024-01-01 00:00:00", 1.0), ("a", None, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, t string, v double").select("series_id", F.col("t").cast("timestamp_ntz").alias("ts"), "v")
    key = dict(key=["series_id"], ts="ts")
    assert sorted((r.rn, r.n) for r in blocks.row_index(df, **key, total="n").where("series_id is null").collect()) == [(0, 3), (1, 3), (2, 3)]
    assert blocks.row_index(df, **key).count() == 5
    assert [r.s for r in blocks.running_sum(df, **key, cols={"v": "s"}).where("series_id is null").orderBy("ts").collect()] == [1.0, 3.0, 6.0]
    assert [r.p for r in blocks.previous_row(df, **key, cols={"v": "p"}).where("series_id is null").orderBy("ts").collect()] == [None, 1.0, 2.0]
    assert blocks.neighbours(df, **key, cols=["v"]).count() == 5
    assert joins.last_rows(df, **key, n=2).where("series_id is null").count() == 2
    assert splits.chrono_split(df, **key).count() == 5
    fit = spark.createDataFrame([(None, 1.0, 2.0), ("a", 0.0, 0.0)], "series_id string, intercept double, slope double")
    assert model.predict_line(df, fit, key=["series_id"], x="v", name="p").where("p is null").count() == 0


def test_series_without_a_common_span_leave_the_others_alone(spark):
    def side(name, spans):
        rows = [(k, f"2024-01-{d:02d} {h:02d}:00:00", float(h)) for k, d in spans for h in range(4)]
        return spark.createDataFrame(rows, f"series_id string, t string, {name} double").select("series_id", F.col("t").cast("timestamp_ntz").alias("ts"), name)

    left, right = side("x", [("a", 1), ("b", 1)]), side("y", [("a", 1), ("b", 9)])
    span = grid.common_range(left, right, key=["series_id"], ts="ts")
    assert {r.series_id: r.lo <= r.hi for r in span.collect()} == {"a": True, "b": False}
    times = grid.spine_between(span, key=["series_id"], low="lo", high="hi", step_s=3600)
    both = joins.asof_nearest(left, right, times, key=["series_id"], ts="ts", left_cols=["x"], right_cols=["y"], step_s=3600)
    assert {r.series_id for r in both.collect()} == {"a"} and both.count() == 4


def test_windows_longer_than_a_block(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    got = blocks.over_rows(df, key=["k"], index="i", before=20, rows=4, exprs=lambda w: {"s": F.sum("v").over(w.rowsBetween(-20, 0))})
    assert {r.i: r.s for r in got.collect()} == {i: float(sum(range(max(0, i - 20), i + 1))) for i in range(50)}


def test_nearest_row_or_nearest_known_value(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0, 5.0), ("a", "2024-01-01 00:20:00", None, 6.0), ("a", "2024-01-01 00:50:00", 3.0, None)]
    df = spark.createDataFrame(rows, "k string, t string, v double, w double").select("k", F.col("t").cast("timestamp_ntz").alias("ts"), "v", "w")
    get = lambda known: [(r.v, r.w) for r in grid.reindex_nearest(df, key=["k"], ts="ts", cols=["v", "w"], step_s=1800, known=known).orderBy("ts").collect()]
    assert get(False) == [(1.0, 5.0), (None, 6.0), (3.0, None)]
    assert get(True) == [(1.0, 5.0), (3.0, 6.0), (3.0, 6.0)]


def test_scratch_leaves_no_files(spark, tmp_path, monkeypatch):
    from sungrid import session

    # The setting of a running session cannot change, so the folder is given here.
    monkeypatch.setattr(session, "_base", lambda _: f"file://{tmp_path}")
    with session.scratch(spark):
        assert session.cut_lineage(spark.range(3)).count() == 3 and list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())
