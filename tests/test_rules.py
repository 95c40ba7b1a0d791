"""Edge rules on small hand-made rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sungrid.functions import clean, solar, timecols as tc
from sungrid.operators import grid, joins, metrics, model, scaling, spectrum, splits, stats, windows
from sungrid.sources import readers


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def series(spark, rows, schema="series_id string, ts string, v double"):
    return ntz(spark.createDataFrame(rows, schema), "ts")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_spring_gap_and_autumn_fold_have_no_utc_time(spark):
    texts = ["2024-03-31 01:50:00", "2024-03-31 02:00:00", "2024-03-31 02:59:00", "2024-03-31 03:00:00",
             "2024-10-27 01:50:00", "2024-10-27 02:00:00", "2024-10-27 02:59:00", "2024-10-27 03:00:00"]
    df = ntz(spark.createDataFrame([(t,) for t in texts], "ts string"), "ts")
    got = [r.u and str(r.u) for r in df.select(tc.local_to_utc(F.col("ts"), "Europe/Vienna").alias("u")).collect()]
    assert got == ["2024-03-31 00:50:00", None, None, "2024-03-31 01:00:00", "2024-10-26 23:50:00", None, None, "2024-10-27 02:00:00"]


def test_floor_and_ceil_before_1970(spark):
    t = F.lit("1969-12-31 23:50:00").cast("timestamp_ntz")
    r = one(spark, tc.floor_ts(t, 3600).alias("f"), tc.ceil_ts(t, 3600).alias("c"), tc.step_index(t, 3600).alias("i"))
    assert str(r.f) == "1969-12-31 23:00:00" and str(r.c) == "1970-01-01 00:00:00" and r.i == -1


def test_european_numbers(spark):
    texts = ["1,5", " 2,25 ", "n/a", "#WERT!", "", " ", "abc", "-3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(clean.euro_double(F.col("t"))).collect()] == [1.5, 2.25, None, None, None, None, None, -3.0, None]


def test_flags_ratios_and_means(spark):
    n = F.lit(None).cast("double")
    r = one(spark, clean.night_below(n, 10).alias("missing"), clean.guarded_ratio(F.lit(9.0), F.lit(3.0), above=1).alias("capped"),
            clean.guarded_ratio(F.lit(9.0), F.lit(1.0), above=1).alias("dark"), clean.row_mean(F.lit(4.0), n).alias("mean"),
            clean.row_mean(n, n).alias("none"), clean.clip(n, 0, 1).alias("clipped"), clean.any_flag(F.lit(None).cast("int"), F.lit(1)).alias("any"))
    assert (r.missing, r.capped, r.dark, r["mean"], r.none, r.clipped, r["any"]) == (1, 1.5, 0.0, 4.0, None, None, 1)


def test_present_columns_only(spark):
    df = spark.createDataFrame([(1, 12, 10)], "a int, f int, g int")
    assert clean.select_present(df, {"a": "x", "zz": "y"}).columns == ["x"]
    assert clean.keep_good(df, ["f", "missing"]).count() == 1 and clean.keep_good(df, ["f", "g"]).count() == 0
    assert clean.pick_column(["time", "first", "Energy kWh"], ["Energy"]) == "Energy kWh" and clean.pick_column(["time", "first"], ["q"]) == "first"
    assert clean.pick_column(["time", "PV Produktion", "Energie"], ["Energie", "PV Produktion"]) == "PV Produktion"  # the first column, not the first term
    with pytest.raises(ValueError):
        clean.first_present(df, ["no"])


def test_empty_bins_sum_to_zero_and_last_is_by_time(spark):
    df = series(spark, [("a", "2024-01-01 00:05:00", 1.0), ("a", "2024-01-01 00:50:00", None), ("a", "2024-01-01 00:40:00", 3.0), ("a", "2024-01-01 02:10:00", 4.0)])
    out = grid.resample(df, key=["series_id"], ts="ts", step_s=3600, aggs={"m": ("v", "mean"), "s": ("v", "sum"), "x": ("v", "max"), "l": ("v", "last"), "gone": ("w", "mean")})
    assert "gone" not in out.columns
    assert [(r.m, r.s, r.x, r.l) for r in out.orderBy("ts").collect()] == [(2.0, 4.0, 3.0, 3.0), (None, 0.0, None, None), (4.0, 4.0, 4.0, 4.0)]


def test_bins_from_the_first_time(spark):
    df = series(spark, [("a", "2024-01-01 00:20:00", 1.0), ("a", "2024-01-01 01:19:00", 2.0), ("a", "2024-01-01 03:30:00", 4.0)])
    out = grid.resample_from_start(df, key=["series_id"], ts="ts", step_s=3600, aggs={"s": ("v", "sum")}).orderBy("ts").collect()
    assert [(str(r.ts)[11:16], r.s) for r in out] == [("00:20", 3.0), ("01:20", 0.0), ("02:20", 0.0), ("03:20", 4.0)]


def test_long_spine_is_cut_into_chunks(spark):
    df = series(spark, [("a", "2024-01-01 00:00:30", 1.0), ("a", "2024-01-10 00:00:30", 1.0)])
    out = grid.time_spine(df, key=["series_id"], ts="ts", step_s=60)
    assert out.count() == out.distinct().count() == 9 * 1440 + 2
    assert out.agg(F.min("ts"), F.max("ts")).first()[1].isoformat() == "2024-01-10T00:01:00"


def test_step_tie_takes_the_smaller(spark):
    df = series(spark, [("a", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 10, 20, 25, 30)])
    r = grid.infer_step(df, key=["series_id"], ts="ts").first()
    assert (r.step_s, r.n_steps) == (300.0, 2)


def test_first_of_duplicates_and_null_key(spark):
    df = spark.createDataFrame([("d", "b", 1), ("d", "a", 2), (None, "c", 3), (None, "b", 4)], "day string, source_file string, x int")
    got = {(r.day, r.source_file, r.x) for r in joins.keep_first(df, key=["day"], order=["source_file"]).collect()}
    assert got == {("d", "a", 2), (None, "b", 4)}


def test_scalers_invert_and_keep_constant_columns(spark):
    df = spark.createDataFrame([("a", float(i), 5.0, i * i * 1.0) for i in range(9)], "series_id string, x double, c double, z double")
    methods = {"x": "minmax", "c": "standard", "z": "robust"}
    params = scaling.fit(df, methods, key=["series_id"])
    there = scaling.transform(df, params, list(methods), key=["series_id"])
    assert [r.c for r in there.collect()] == [0.0] * 9
    z = np.array([i * i for i in range(9)], float)
    q = np.percentile(z, [25, 50, 75])
    np.testing.assert_allclose(sorted(r.z for r in there.collect()), (z - q[1]) / (q[2] - q[0]))
    back = scaling.transform(there, params, list(methods), key=["series_id"], inverse=True)
    np.testing.assert_allclose(sorted((r.x, r.z) for r in back.collect()), sorted((float(i), float(i * i)) for i in range(9)))
    with pytest.raises(ValueError):
        scaling.fit(df, {"x": "unknown"}, key=["series_id"])


def test_split_sizes_and_folds(spark):
    df = spark.range(103).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"))
    counts = dict(splits.chrono_split(df, key=["k"], ts="ts").groupBy("split").count().collect())
    assert counts == {"train": 72, "val": 15, "test": 16}
    folds = splits.expanding_folds(df, key=["k"], ts="ts", k=5).toPandas()
    seen = set()
    for fold, part in folds.groupby("fold"):
        train, val = (set(part[part.role == r].rn) for r in ("train", "val"))
        assert len(val) == 103 // 6 and max(train) + 1 == min(val) and train == set(range(len(train))) and not val & seen
        seen |= val
    assert max(seen) == 102
    again = [splits.random_split(df, key=["ts"]).where("split = 'test'").count() for _ in range(2)]
    assert again[0] == again[1] and 5 <= again[0] <= 40


def test_percentage_errors_at_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 4.0)], "k string, y double, p double")
    y, p = F.col("y"), F.col("p")
    r = metrics.measure(df, metrics.mape(y, p), metrics.smape(y, p), metrics.basic(y, p), group=["k"]).first()
    assert r.mape_zero_as_none == pytest.approx(12.5) and r.mape_skip_zero == pytest.approx(25.0) and r.mape_raw == pytest.approx(25.0)
    assert r.mape_eps == pytest.approx(100 * (1e8 + 0.5) / 4, rel=1e-6)
    assert r.smape_half == pytest.approx((2 + 2 / 3) / 4 * 100) and r.smape_skip_zero == pytest.approx((2 + 2 / 3) / 3 * 100)
    assert r.r2 == pytest.approx(1 - 2 / 11) and r.rmse == pytest.approx(math.sqrt(0.5))


def test_threshold_curve_against_direct_counts(spark):
    rng = np.random.default_rng(4)
    y = np.round(rng.random(300) * 10, 1)
    p = np.round(np.clip(y * 0.4 + rng.normal(0, 1, 300), 0, None), 1)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "y": y, "p": p}))
    got = metrics.threshold_curve(df, key=["k"], y="y", pred="p").toPandas().set_index("step")
    lo, hi = min(y.min(), p.min()), max(y.max(), p.max())
    want = {}
    for i in range(100):
        t = lo + i * ((hi - lo) / 99.0)
        real, said = y > t, p > t
        if 0 < real.sum() < len(y):
            same = said.all() or not said.any()
            want[i] = (1.0, 1.0) if same else ((real & said).sum() / real.sum(), (~real & said).sum() / (~real).sum())
    assert set(got.index) == set(want)
    for i, (tpr, fpr) in want.items():
        assert (got.tpr[i], got.fpr[i]) == pytest.approx((tpr, fpr))


def test_range_errors_have_empty_ranges(spark):
    df = spark.createDataFrame([(-5.0, 0.0), (50.0, 60.0), (20_000.0, 20_001.0)], "y double, p double")
    got = stats.rmse_by_range(df, y="y", pred="p").orderBy("range").collect()
    assert [(r.n, round(r.rmse, 3)) for r in got] == [(2, 7.906), (0, 0.0), (0, 0.0), (0, 0.0), (0, 0.0), (1, 1.0)]


def test_lag_of_a_shifted_day(spark):
    curve = [0, 0, 0, 1, 4, 9, 12, 9, 4, 1, 0, 0, 0, 0, 0, 0]
    rows = [("a", f"2024-01-01 {h:02d}:00:00", 50.0 * curve[h], 100.0 * (curve[h - 2] if h >= 2 else 0)) for h in range(16)]
    rows += [("a", f"2024-01-02 {h:02d}:00:00", 1.0 * h, 1.0 * h) for h in range(16)]  # too small a peak
    df = series(spark, rows, "series_id string, ts string, g double, p double")
    got = stats.daily_lags(df, key=["series_id"], ts="ts", driver="g", power="p", max_lag=3).collect()
    assert [(str(r.day), r.lag) for r in got] == [("2024-01-01", 2)]


def test_spectrum_finds_the_period(spark):
    n = 600
    v = 3 * np.sin(2 * np.pi * np.arange(n) / 16)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(n) + 1000, "v": v}))
    got = spectrum.welch(df, key=["k"], index="i", value="v", n=128, fs=1.0).toPandas().sort_values("bin")
    assert len(got) == 65 and (got.n_segments == 8).all()
    odd = spectrum.welch(df, key=["k"], index="i", value="v", n=127, fs=1.0).toPandas()
    assert len(odd) == 64 and (odd.n_segments == (n - 127) // 63 + 1).all()
    assert got.bin[got.psd.idxmax()] == 8 and got.psd.sum() / 128 == pytest.approx(4.5, rel=1e-6)


def test_ridge_search_equals_refits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 2)) * [1.0, 5.0]
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=60)
    pdf = pd.DataFrame({"k": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(60), "h"), "a": x[:, 0], "b": x[:, 1], "y": y})
    got = model.ridge_search(ntz(spark.createDataFrame(pdf), "ts"), key=["k"], ts="ts", features=["a", "b"], y="y", penalties=[0.0, 2.0], k=5).toPandas().set_index("penalty")
    for lam in (0.0, 2.0):
        losses = []
        for fold in range(5):
            start = 60 - (5 - fold) * 10
            xt, yt = x[:start], y[:start]
            cov = np.cov(np.column_stack([xt, yt]).T, bias=True)
            beta = np.linalg.solve(cov[:2, :2] + lam * np.eye(2), cov[:2, 2])
            pred = yt.mean() + (x[start:start + 10] - xt.mean(axis=0)) @ beta
            losses.append(((y[start:start + 10] - pred) ** 2).mean())
        assert got.mean_loss[lam] == pytest.approx(np.mean(losses))


def test_forecast_rows_shift_the_window(spark):
    hist = series(spark, [("a", f"2024-01-01 {h:02d}:00:00", float(h)) for h in range(6)]).withColumn("night", F.lit(0))
    # 07:00 is known, 08:00 is missing and repeats it, 09:00 is at night.
    ahead = ntz(spark.createDataFrame([("a", "2024-01-01 06:00:00", 99.0, 0), ("a", "2024-01-01 07:00:00", 70.0, 0), ("a", "2024-01-01 09:00:00", 90.0, 1)], "series_id string, ts string, v double, night int"), "ts")
    total = lambda x: F.aggregate(F.transform(x, lambda r: r["v"]), F.lit(0.0), lambda a, b: a + b)
    got = model.forecast_next(hist, ahead, key=["series_id"], ts="ts", features=["v"], night="night", n=3, score=total, horizon=5).orderBy("ts").collect()
    assert [(r.hour_ahead, str(r.ts)[11:13], r.power_w) for r in got] == [
        (1, "06", 3 + 4 + 5.0), (2, "07", 4 + 5 + 70.0), (3, "08", 5 + 70 + 70.0), (4, "09", 0.0), (5, "10", 0.0)]


def test_solar_noon_and_clear_sky(spark):
    t = F.lit("2024-03-20 12:00:00").cast("timestamp_ntz")
    df = spark.range(1).select(t.alias("ts"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    r = solar.with_sun(df).first()
    assert r.zenith_deg < 2.5 and r.apparent_elev_deg > 87
    sky = solar.clear_sky(F.lit(90.0), F.lit(101325.0))
    s = one(spark, *[c.alias(n) for n, c in sky.items()])
    assert (s.clear_dni, s.clear_ghi, s.clear_dhi) == pytest.approx((963, 1084, 130), abs=2)
    night = one(spark, *[c.alias(n) for n, c in solar.clear_sky(F.lit(-3.0), F.lit(101325.0)).items()])
    assert tuple(night) == (0.0, 0.0, 0.0)
    m = one(spark, solar.incidence_modifier(F.lit(0.0)).alias("front"), solar.incidence_modifier(F.lit(90.0)).alias("edge"),
            solar.altitude_pressure(F.lit(0.0)).alias("sea"))
    assert m.front == 1.0 and m.edge == 0.0 and m.sea == pytest.approx(101325, abs=5)


def test_units_rows_and_merge(spark, tmp_path):
    for name, text in (("fine", "Zeit;Energie\n[dd.MM.yyyy HH:mm];[Wh]\n01.02.2024 00:05;500,5\n01.02.2024 00:10;n/a\n01.02.2024 00:15;499,5\n"),
                       ("coarse", "Zeit;Energie\n[dd.MM.yyyy];[kWh]\n02.02.2024;16,25\n")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part.csv").write_text(text)
    got = {(str(r.day), r.energy_kwh, r.source_file, r.data_type) for r in readers.merge_exports(readers.read_exports(spark, str(tmp_path))).collect()}
    assert got == {("2024-02-01", 1.0, "part.csv", "5min_aggregated"), ("2024-02-02", 16.25, "part.csv", "daily")}


def test_flat_folder_of_mixed_exports(spark, tmp_path):
    """Each file by its own header and first cell; no row of another file suffers."""
    texts = {
        "a fine.csv": "Datum und Uhrzeit;PV Produktion;Energie\n[dd.MM.yyyy HH:mm];[Wh];[1]\n01.02.2024 00:05;500,5;9\n01.02.2024 00:10;499,5;9\n",
        "b swapped.csv": '\ufeff"Nummer";"Energie | Symo";"Datum"\n[1];[kWh];[dd.MM.yyyy]\n77;5,5;02.02.2024\n78;NaN;03.02.2024\n',
        "c stray.csv": "Zeit;Wert\n[dd.MM.yyyy];[kWh]\n01.02.2024;1\n02.01.2024 00:00;2\n04.02.2024;3\n",
        "d untimed.csv": "x;y\n1;2\n",
        "e short.csv": "Datum;Energie\n05.02.2024\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = sorted(((str(r.day), r.energy_kwh, r.source_file, r.data_type) for r in readers.merge_exports(readers.read_exports(spark, str(tmp_path))).collect()), key=str)
    assert got == sorted([
        ("2024-02-01", 1.0, "a fine.csv", "5min_aggregated"), ("2024-02-02", 5.5, "b swapped.csv", "daily"), ("2024-02-03", None, "b swapped.csv", "daily"),
        ("2024-02-01", 1.0, "c stray.csv", "daily"), ("None", 2.0, "c stray.csv", "daily"), ("2024-02-04", 3.0, "c stray.csv", "daily"), ("2024-02-05", None, "e short.csv", "daily")], key=str)


def test_nan_text_is_missing(spark):
    r = one(spark, clean.coerce_double(F.lit("NaN")).alias("a"), clean.euro_double(F.lit("nan")).alias("b"), clean.coerce_double(F.lit("1.5")).alias("c"))
    assert tuple(r) == (None, None, 1.5)


def test_a_total_loss_is_total(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.0), ("b", 0.5), ("b", 0.5), ("b", None)], "k string, p double")
    got = {r.k: r.l for r in df.groupBy("k").agg(solar.total_loss(F.col("p")).alias("l")).collect()}
    assert got["a"] == 1.0 and got["b"] == pytest.approx(0.75)


def test_columns_that_do_not_vary(spark):
    rows = [("a", float(i), 5.0, float(i), 2.0 * i) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, i double, c double, x double, y double").withColumn("i", F.col("i").cast("long"))
    got = {(r.a, r.b): r.r for r in stats.pair_correlations(df, key=["k"], cols=["c", "x", "y"]).collect()}
    assert got[("c", "x")] is None and got[("x", "y")] == pytest.approx(1.0)
    assert {r.feature: r["rank"] for r in stats.target_correlations(df, key=["k"], target="y", features=["c", "x"]).collect()} == {"x": 1, "c": 2}
    assert metrics.measure(df, metrics.pearson_r2(F.col("y"), F.col("c")), metrics.basic(F.col("c"), F.col("c")), group=["k"]).first()[1:3] == (None, 6)
    assert [r.r for r in windows.rolling_corr(df, key=["k"], index="i", a="c", b="x", n=3, name="r", rows=4).collect()] == [None] * 6
    fit = stats.linear_fit(df, key=["k"], x="c", y="y").first()
    assert fit.slope is None and fit.n == 6
    bins = stats.histogram(df, key=["k"], value="c", bins=5).collect()
    assert sorted((r.bin, r.n) for r in bins) == [(0, 6), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_station_takes_local_times_and_keeps_sites_without_a_place(spark):
    from sungrid.plans import station

    def series(name, times, **cols):
        rows = [(k, t, *[float(f(i)) for f in cols.values()]) for k in ("a", "b") for i, t in enumerate(times)]
        return spark.createDataFrame(rows, f"series_id string, t string, {', '.join(f'{c} double' for c in cols)}").select("series_id", F.col("t").cast("timestamp_ntz").alias("ts"), *cols)

    utc = [f"2024-03-31 00:{m:02d}:00" for m in range(0, 60, 10)] + [f"2024-03-31 01:{m:02d}:00" for m in range(0, 60, 10)]
    # Vienna is one hour ahead until 01:00 UTC, then two; 02:00 to 03:00 local do not exist
    wall = [f"2024-03-31 01:{m:02d}:00" for m in range(0, 60, 10)] + ["2024-03-31 02:30:00"] + [f"2024-03-31 03:{m:02d}:00" for m in range(0, 60, 10)]
    weather = series("w", utc, ghi_wm2=lambda i: i, temp_c=lambda i: 5, wind_ms=lambda i: 1, pressure_hpa=lambda i: 950)
    power = series("p", wall, power_w=lambda i: i, energy_wh=lambda i: 100 + i, energy_interval=lambda i: 1)
    places = spark.createDataFrame([("a", 48.0, 16.0, 200.0)], "series_id string, lat double, lon double, alt double")
    table = station.prepare_station(weather, power, places, key=["series_id"], local_power=True, first_day="2024-03-31").cache()
    a = table.where("series_id = 'a'").orderBy("ts").collect()
    assert [r.power_w for r in a] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12] and a[0].zenith_deg is not None  # the row in the gap went
    b = table.where("series_id = 'b'").collect()
    assert len(b) == len(a) and all(r.zenith_deg is None and r.clear_ghi is None and r.ghi_wm2 is not None for r in b)
    hours = station.to_hourly(table.where("series_id = 'a'"), key=["series_id"]).orderBy("ts").collect()
    assert [(r.energy_wh, r.energy_interval) for r in hours] == [(105.0, 6.0), (112.0, 6.0)]
