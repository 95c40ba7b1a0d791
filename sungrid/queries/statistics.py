"""Profiles, correlations, distributions, lags, seasons and spectra."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clean import night_below
from ..operators import information, metrics, spectrum, stationarity, stats, windows
from ..operators.grid import fill_edges
from ..operators.ranks import kendall_matrix
from ..session import cut_lineage
from .base import (
    DAILY_SQL, E10_SQL, E1H_SQL, EV_SQL, KEY, P2_SQL, PAIR_SQL, R, ROLES, WEEK, daily, hourly, pairs, query, readings, rounded, scored, table,
    ten_minutes, tidy,
)
from .grids import indexed

FEATURES = list(ROLES)
COMPLETE_SQL = f"{PAIR_SQL}, comp AS (SELECT * FROM pair WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})"


@query("profile_by_hour", f"""WITH {E1H_SQL} SELECT series_id, hour(ts) AS hour, count(v_mean) AS v_mean_n, {R('avg(v_mean)')} AS v_mean_mean, {R('stddev_samp(v_mean)')} AS v_mean_std,
  count(v_sum) AS v_sum_n, {R('avg(v_sum)')} AS v_sum_mean, {R('stddev_samp(v_sum)')} AS v_sum_std FROM e1h GROUP BY 1, 2""")
def profile_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir).withColumn("hour", F.hour("ts").cast("long"))
    return tidy(stats.profile(df, group=["series_id", "hour"], values=["v_mean", "v_sum"]))


@query("profile_by_month", f"""WITH {DAILY_SQL} SELECT series_id, month(ts) AS month, count(v) AS v_n, {R('avg(v)')} AS v_mean, {R('stddev_samp(v)')} AS v_std FROM daily GROUP BY 1, 2""")
def profile_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.profile(daily(spark, sf_dir).withColumn("month", F.month("ts").cast("long")), group=["series_id", "month"], values=["v"]))


@query("pivot_month_hour", "SELECT month(l_shipdate) AS month, " + ", ".join(R(f"avg(CASE WHEN l_orderkey % 24 = {h} THEN l_quantity END)") + f" AS h{h}" for h in range(24)) + " FROM lineitem GROUP BY 1")
def pivot_month_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").cast("long").alias("month"), (F.col("l_orderkey") % 24).alias("hour"), "l_quantity")
    return tidy(stats.pivot_mean(li, group=["month"], by="hour", labels=range(24), value="l_quantity", prefix="h"))


_MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_columns", " UNION ALL ".join(
    f"""SELECT l_returnflag AS series_id, '{c}' AS feature, count({c}) AS n, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, {R(f'min({c})', 4)} AS min, {R(f'max({c})', 4)} AS max,
    {R(f'quantile_cont({c}, 0.25)', 4)} AS q25, {R(f'quantile_cont({c}, 0.5)', 4)} AS median, {R(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM lineitem GROUP BY 1""" for c in _MEASURED))
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "series_id")
    return tidy(stats.describe(li, key=KEY, cols=_MEASURED), 4)


@query("missing_counts", f"WITH {PAIR_SQL} " + " UNION ALL ".join(
    f"SELECT series_id, count(*) AS n_rows, '{c}' AS feature, count(*) - count({c}) AS n_missing FROM pair GROUP BY 1" for c in FEATURES))
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.missing_counts(pairs(spark, sf_dir), key=KEY, cols=FEATURES)


@query("night_day_summary", f"""WITH {PAIR_SQL}, f AS (SELECT *, coalesce(ghi, 0) < 60 AS night FROM pair) SELECT series_id, count(*) AS n_rows, count(*) FILTER (night) AS n_night, count(*) FILTER (NOT night) AS n_day,
  {R('count(*) FILTER (night) * 100.0 / count(*)')} AS night_pct, {R('avg(power) FILTER (night)')} AS night_mean, {R('avg(power) FILTER (NOT night)')} AS day_mean, {R('max(power) FILTER (night)')} AS night_max FROM f GROUP BY 1""")
def night_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir).withColumn("is_night", night_below(F.col("ghi"), 60))
    return tidy(stats.night_day_summary(df, key=KEY, night="is_night", power="power"))


_PAIRS = list(combinations(FEATURES, 2))


def _corr_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT series_id, '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM {source} GROUP BY 1" for a, b in _PAIRS)


_RANKED_SQL = f"{COMPLETE_SQL}, rk AS (SELECT series_id, ts, " + ", ".join(
    f"rank() OVER (PARTITION BY series_id ORDER BY {c}) + (count(*) OVER (PARTITION BY series_id, {c}) - 1) / 2.0 AS {c}" for c in FEATURES) + " FROM comp)"


@query("corr_pearson", f"WITH {COMPLETE_SQL} {_corr_sql('comp')}")
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.pair_correlations(pairs(spark, sf_dir), key=KEY, cols=FEATURES))


@query("corr_spearman", f"WITH {_RANKED_SQL} {_corr_sql('rk')}")
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.spearman_correlations(cut_lineage(pairs(spark, sf_dir)), key=KEY, ids=["ts"], cols=FEATURES))


_CONCORDANT = ", ".join(f"sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS s_{x}_{y}" for x, y in _PAIRS) + ", " + ", ".join(f"sum(abs(sign(a.{c} - b.{c}))) AS f_{c}" for c in FEATURES)


@query("corr_kendall", f"""WITH {COMPLETE_SQL}, s AS (SELECT series_id, count(DISTINCT a.ts) AS n, {_CONCORDANT} FROM comp a JOIN comp b USING (series_id) GROUP BY 1) """ + " UNION ALL ".join(
    f"SELECT series_id, '{x}' AS a, '{y}' AS b, n, {R(f's_{x}_{y} / sqrt(f_{x} * f_{y})')} AS tau FROM s" for x, y in _PAIRS))
def corr_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(kendall_matrix(pairs(spark, sf_dir), group=KEY, cols=FEATURES))


_TARGETED = [c for c in FEATURES if c != "power"]


@query("top_correlations", f"""WITH {COMPLETE_SQL}, c AS ({' UNION ALL '.join(f"SELECT series_id, '{f}' AS feature, corr({f}, power) AS r FROM comp GROUP BY 1" for f in _TARGETED)})
  SELECT series_id, feature, {R('r')} AS r, rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC, feature) AS rank FROM c) WHERE rank <= 3""")
def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.target_correlations(pairs(spark, sf_dir), key=KEY, target="power", features=_TARGETED, top=3))


_WIDE = ["v_mean", "v_sum", "v_max", "v_last"]


@query("redundant_features", f"WITH {E1H_SQL}, c AS (SELECT * FROM e1h WHERE v_mean IS NOT NULL), p AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM c GROUP BY 1" for a, b in combinations(_WIDE, 2)) + f") SELECT series_id, a, b, {R('r')} AS r FROM p WHERE abs(r) > 0.8")
def redundant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.redundant_pairs(hourly(spark, sf_dir), key=KEY, cols=_WIDE, above=0.8))


_BINNED_SQL = f"{COMPLETE_SQL}, bn AS (SELECT series_id, " + ", ".join(
    f"(rank() OVER (PARTITION BY series_id ORDER BY {c}) - 1) * 8 // count(*) OVER (PARTITION BY series_id) AS {c}" for c in FEATURES) + " FROM comp)"


@query("mutual_information", f"WITH {_BINNED_SQL}, lg AS (" + " UNION ALL ".join(f"SELECT series_id, '{f}' AS feature, {f} AS b, power AS t FROM bn" for f in _TARGETED) + f"""),
  c AS (SELECT series_id, feature, b, t, count(*)::DOUBLE AS c FROM lg GROUP BY ALL),
  m AS (SELECT *, sum(c) OVER (PARTITION BY series_id, feature) AS n, sum(c) OVER (PARTITION BY series_id, feature, b) AS cx, sum(c) OVER (PARTITION BY series_id, feature, t) AS cy FROM c)
  SELECT series_id, feature, {R('sum(c / n * ln(c * n / (cx * cy)))')} AS mi FROM m GROUP BY 1, 2""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.mutual_information(cut_lineage(pairs(spark, sf_dir)), key=KEY, ids=["ts"], target="power", features=_TARGETED, k=8))


# Every pair of hours; digamma as the same series on both sides.
_PSI = lambda n: f"(ln({n} + 8.0) - 1 / (2.0 * ({n} + 8)) - 1 / (12.0 * pow({n} + 8, 2)) + 1 / (120.0 * pow({n} + 8, 4)) - 1 / (252.0 * pow({n} + 8, 6)) - " + " - ".join(f"1.0 / ({n} + {i})" for i in range(8)) + ")"


@query("mutual_information_knn", f"WITH {COMPLETE_SQL}, lg AS (" + " UNION ALL ".join(f"SELECT series_id, ts, '{f}' AS feature, {f} AS x, power AS y FROM comp" for f in _TARGETED) + f"""),
  u AS (SELECT series_id, ts, feature, x / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS x, y / coalesce(nullif(stddev_pop(y) OVER w, 0), 1) AS y, count(*) OVER w AS n FROM lg WINDOW w AS (PARTITION BY series_id, feature)),
  e AS (SELECT a.series_id, a.feature, a.ts, a.x, a.y, a.n, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[4] AS eps FROM u a JOIN u b USING (series_id, feature) GROUP BY ALL),
  c AS (SELECT e.series_id, e.feature, e.ts, e.n, count(*) FILTER (CASE WHEN eps > 0 THEN abs(e.x - b.x) < eps * (1 - 1e-9) ELSE e.x = b.x END) AS nx,
    count(*) FILTER (CASE WHEN eps > 0 THEN abs(e.y - b.y) < eps * (1 - 1e-9) ELSE e.y = b.y END) AS ny FROM e JOIN u b USING (series_id, feature) GROUP BY ALL)
  SELECT series_id, feature, CASE WHEN n > 3 THEN {R(f"greatest({_PSI('n')} + {_PSI('3')} - avg({_PSI('nx')} + {_PSI('ny')}), 0)")} END AS mi FROM c GROUP BY series_id, feature, n""")
def mutual_information_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(information.mutual_information_knn(pairs(spark, sf_dir), key=KEY, target="power", features=_TARGETED, k=3))


_HIST = "least(coalesce(floor((value - lo) / nullif((hi - lo) / 50.0, 0)), 0), 49)::BIGINT"


# Every bin of every series, filled or not.
_BINS = f"""SELECT b.series_id, g.k AS bin, {R('min(lo) + g.k * ((min(hi) - min(lo)) / 50.0)')} AS bin_start, count(h.bin) AS n
  FROM b CROSS JOIN (SELECT unnest(range(50)) AS k) g
  LEFT JOIN (SELECT series_id, {_HIST} AS bin FROM {{src}} JOIN b USING (series_id) WHERE value IS NOT NULL) h ON h.series_id = b.series_id AND h.bin = g.k
  WHERE lo IS NOT NULL GROUP BY 1, 2"""


@query("histogram", f"""WITH {EV_SQL}, b AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1)
  {_BINS.format(src='ev')}""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.histogram(readings(spark, sf_dir), key=KEY, value="value", bins=50))


@query("boxplot_by_hour", f"""WITH {EV_SQL}, e AS (SELECT hour(ts) AS hour, value FROM ev WHERE value IS NOT NULL),
  q AS (SELECT hour, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM e GROUP BY 1),
  j AS (SELECT *, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM e JOIN q USING (hour))
  SELECT hour, {R('q25')} AS q25, {R('median')} AS median, {R('q75')} AS q75, {R('min(value) FILTER (inside)')} AS whisker_low, {R('max(value) FILTER (inside)')} AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
  FROM j GROUP BY hour, j.q25, j.median, j.q75""")
def boxplot_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readings(spark, sf_dir).withColumn("hour", F.hour("ts").cast("long"))
    return tidy(stats.boxplot(df, group=["hour"], value="value"))


_EDGES = list(stats.RANGE_EDGES)
_PLACE = "CASE " + " ".join(f"WHEN y_true >= {e} THEN {i}" for i, e in reversed(list(enumerate(_EDGES[1:-1], start=1)))) + " ELSE 0 END"


@query("rmse_by_range", f"WITH {P2_SQL}, b AS (SELECT {_PLACE} AS range, y_true, y_pred FROM (SELECT y_true * 12 AS y_true, y_pred * 12 AS y_pred FROM p2)), g(range, low, high) AS (VALUES " + ", ".join(
    f"({i}, {a}.0, {b}.0)" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + f""") SELECT g.range::BIGINT AS range, {R('g.low')} AS low, {R('g.high')} AS high,
  {R('coalesce(sqrt(sum((y_true - y_pred) * (y_true - y_pred)) / nullif(count(y_true), 0)), 0)')} AS rmse, count(y_true) AS n FROM g LEFT JOIN b USING (range) GROUP BY 1, g.low, g.high""")
def rmse_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p2 = scored(spark, sf_dir).select((F.col("y_true") * 12).alias("y_true"), (F.col("y_pred") * 12).alias("y_pred"))
    return tidy(stats.rmse_by_range(p2, y="y_true", pred="y_pred"))


@query("linear_fit", f"""WITH {PAIR_SQL} SELECT series_id, regr_count(power, ghi)::BIGINT AS n, {R('regr_slope(power, ghi)')} AS slope, {R('regr_intercept(power, ghi)')} AS intercept, {R('regr_r2(power, ghi)')} AS r2
  FROM (SELECT series_id, power, CASE WHEN ghi > 50 THEN ghi END AS ghi FROM pair) GROUP BY 1""")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.linear_fit(pairs(spark, sf_dir), key=KEY, x="ghi", y="power", x_above=50))


@query("residuals_by_hour", f"""WITH {P2_SQL} SELECT hour(ts) AS hour, count(*) AS n, {R('avg(y_true)')} AS actual, {R('avg(y_pred)')} AS predicted, {R('avg(y_true - y_pred)')} AS residual, {R('stddev_samp(y_true - y_pred)')} AS residual_std FROM p2 GROUP BY 1""")
def residuals_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("y_true") - F.col("y_pred")
    return tidy(scored(spark, sf_dir).groupBy(F.hour("ts").cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("actual"), F.avg("y_pred").alias("predicted"), F.avg(gap).alias("residual"), F.stddev_samp(gap).alias("residual_std")))


@query("residual_histogram", f"""WITH {P2_SQL}, e AS (SELECT series_id, y_true - y_pred AS value FROM p2), b AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1)
  {_BINS.format(src='e')}""")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = scored(spark, sf_dir).select("series_id", (F.col("y_true") - F.col("y_pred")).alias("value"))
    return tidy(stats.histogram(res, key=KEY, value="value", bins=50))


@query("forecast_summary", f"""WITH {P2_SQL} SELECT series_id, {R('sum(y_pred) / 1000')} AS total_kwh, {R('max(y_pred)')} AS peak_w, (SELECT min(q.ts) FROM p2 q WHERE q.series_id = p2.series_id AND q.y_pred = max(p2.y_pred)) AS peak_ts,
  {R('avg(y_pred)')} AS mean_w, min(ts) AS first_ts, max(ts) AS last_ts, count(y_pred) AS n, {R('sum(y_pred) * 0.8 / 1000')} AS low_kwh, {R('sum(y_pred) * 1.2 / 1000')} AS high_kwh FROM p2 GROUP BY series_id""")
def forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.forecast_summary(scored(spark, sf_dir), key=KEY, ts="ts", power="y_pred"))


@query("variability", f"""WITH {E10_SQL}, h AS (SELECT series_id, date_trunc('hour', ts) AS h, stddev_samp(v) AS s, avg(v) AS m FROM e10 GROUP BY 1, 2)
  SELECT series_id, hour(h) AS hour, {R('avg(s)')} AS within_hour_std, {R('stddev_samp(m)')} AS across_days_std FROM h GROUP BY 1, 2""")
def variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.variability(ten_minutes(spark, sf_dir), key=KEY, ts="ts", value="v"))


_LAG_SQL = f"""{PAIR_SQL}, r0 AS (SELECT series_id, ts::DATE AS day, ts, ghi, power FROM pair WHERE ghi IS NOT NULL AND power IS NOT NULL),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY ts) AS i, count(*) OVER d AS n, max(power) OVER d AS peak,
    (ghi - min(ghi) OVER d) / (max(ghi) OVER d - min(ghi) OVER d + 1e-10) AS r, (power - min(power) OVER d) / (max(power) OVER d - min(power) OVER d + 1e-10) AS p FROM r0 WINDOW d AS (PARTITION BY series_id, day)),
  sc AS (SELECT a.series_id, a.day, g.lag, sum(a.p * b.r) AS score FROM r1 a CROSS JOIN generate_series(-3, 3) g(lag) JOIN r1 b ON a.series_id = b.series_id AND a.day = b.day AND b.i = a.i - g.lag WHERE a.n >= 12 AND a.peak >= 100 GROUP BY 1, 2, 3),
  best AS (SELECT series_id, day, lag, score FROM sc QUALIFY row_number() OVER (PARTITION BY series_id, day ORDER BY score DESC, lag) = 1)"""


@query("optimal_lag", f"WITH {_LAG_SQL} SELECT series_id, count(*) AS n_days, {R('median(lag)')} AS median_lag, {R('median(lag) * 60')} AS lag_minutes, {R('avg(score)')} AS mean_score FROM best GROUP BY 1")
def optimal_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = stats.daily_lags(pairs(spark, sf_dir), key=KEY, ts="ts", driver="ghi", power="power", max_lag=3)
    return tidy(stats.typical_lag(days, key=KEY, step_minutes=60))


@query("daily_lags", f"WITH {_LAG_SQL} SELECT series_id, day, lag, {R('score')} AS score FROM best")
def daily_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.daily_lags(pairs(spark, sf_dir), key=KEY, ts="ts", driver="ghi", power="power", max_lag=3))


@query("acf", f"""WITH {E1H_SQL}, d AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, v_sum - avg(v_sum) OVER (PARTITION BY series_id) AS x FROM e1h),
  q AS (SELECT series_id, sum(x * x) AS sq FROM d GROUP BY 1)
  SELECT a.series_id, g.lag, {R('sum(a.x * b.x) / min(sq)')} AS acf FROM d a CROSS JOIN generate_series(1, 50) g(lag) JOIN d b ON a.series_id = b.series_id AND b.i = a.i - g.lag JOIN q ON q.series_id = a.series_id GROUP BY 1, 2""")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats.autocorrelation(cut_lineage(indexed(hourly(spark, sf_dir), 3600)), key=KEY, index="i", value="v_sum", lags=50, rows=256))


_ACF_LIST = f"""{E1H_SQL}, d AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, v_sum - avg(v_sum) OVER (PARTITION BY series_id) AS x FROM e1h),
  q AS (SELECT series_id, sum(x * x) AS sq FROM d GROUP BY 1),
  a AS (SELECT a.series_id, g.lag, sum(a.x * b.x) / min(sq) AS acf FROM d a CROSS JOIN generate_series(1, 50) g(lag) JOIN d b ON a.series_id = b.series_id AND b.i = a.i - g.lag JOIN q ON q.series_id = a.series_id GROUP BY 1, 2),
  r AS (SELECT series_id, list(acf ORDER BY lag) AS r FROM a GROUP BY 1)"""


# Step k of the recursion has the weights w of the best prediction from k rows and the variance v it leaves.
@query("pacf", f"""WITH RECURSIVE {_ACF_LIST}, s AS (
  SELECT series_id, r, 1 AS k, [r[1]] AS w, 1 - r[1] * r[1] AS v FROM r
  UNION ALL
  SELECT series_id, r, k + 1, list_append([w[i] - p * w[k + 1 - i] for i in range(1, k + 1)], p), v * (1 - p * p)
  FROM (SELECT *, (r[k + 1] - list_sum([w[j] * r[k + 1 - j] for j in range(1, k + 1)])) / v AS p FROM s) WHERE k < len(r))
  SELECT series_id, k::BIGINT AS lag, {R('w[k]')} AS pacf FROM s""")
def pacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stationarity.partial_autocorrelation(cut_lineage(indexed(hourly(spark, sf_dir), 3600)), key=KEY, index="i", value="v_sum", lags=50, rows=256))


_CRITICAL = ", ".join(R(" + ".join(f"({x}) / pow(n, {i})" for i, x in enumerate(xs))) + f" AS {c}" for c, xs in stationarity.CRITICAL.items())


# With one change before, the two slopes and their errors have a closed form in covariances.
@query("unit_root", f"""WITH {DAILY_SQL}, l AS (SELECT series_id, ts, v, lag(v) OVER o AS x, lag(v, 2) OVER o AS x2 FROM daily WINDOW o AS (PARTITION BY series_id ORDER BY ts)),
  c AS (SELECT series_id, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x - x2, x - x2) AS zz, covar_pop(x, x - x2) AS xz, covar_pop(x, v - x) AS xy, covar_pop(x - x2, v - x) AS zy, covar_pop(v - x, v - x) AS yy
    FROM l WHERE x2 IS NOT NULL GROUP BY 1),
  w AS (SELECT *, xx * zz - xz * xz AS d, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS g FROM c)
  SELECT series_id, {R('b / sqrt((yy - b * xy - g * zy) / (n - 3) * zz / d)')} AS statistic, 1::BIGINT AS lags, n::BIGINT AS n_used, {_CRITICAL} FROM w""")
def unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(indexed(daily(spark, sf_dir), 86_400))
    return tidy(stationarity.unit_root_test(rows, key=KEY, index="i", value="v", lags=1, rows=512).drop("p_value"))


@query("unit_root_chosen_lags")
def unit_root_chosen_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(indexed(daily(spark, sf_dir), 86_400))
    return tidy(stationarity.unit_root_test(rows, key=KEY, index="i", value="v", rows=512))


@query("lag_pairs", f"WITH {E1H_SQL} SELECT * FROM (SELECT series_id, ts, {R('v_sum')} AS x, {R('lag(v_sum) OVER (PARTITION BY series_id ORDER BY ts)')} AS x_before FROM e1h) WHERE x_before IS NOT NULL")
def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.previous_row(hourly(spark, sf_dir).select("series_id", "ts", F.col("v_sum").alias("x")), key=KEY, ts="ts", cols={"x": "x_before"}, block_s=WEEK)
    return tidy(rows.where(F.col("x_before").isNotNull()))


def _decompose_sql(period: int) -> str:
    half = period // 2
    o = "OVER (PARTITION BY series_id ORDER BY ts"
    span = f"{o} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    if period % 2:
        mean = f"avg(v) {span}"
    else:
        inner = f"{o} ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
        mean = f"(sum(v) {inner} + (lag(v, {half}) {o}) + lead(v, {half}) {o})) / 2) / {period}"
    return f"""t AS (SELECT series_id, ts, v, row_number() {o}) % {period} AS ph, CASE WHEN count(v) {span} = {2 * half + 1} THEN {mean} END AS trend FROM src),
  ph AS (SELECT series_id, ph, avg(v - trend) AS p FROM t GROUP BY 1, 2), se AS (SELECT series_id, ph, p - avg(p) OVER (PARTITION BY series_id) AS seasonal FROM ph)
  SELECT series_id, ts, {R('v')} AS v, {R('trend')} AS trend, {R('seasonal')} AS seasonal, {R('v - trend - seasonal')} AS residual FROM t JOIN se USING (series_id, ph)"""


def _decompose(df: DataFrame, step_s: int, period: int, rows: int) -> DataFrame:
    return tidy(stats.seasonal_decompose(indexed(df, step_s), key=KEY, index="i", ts="ts", value="v", period=period, rows=rows))


@query("seasonal_decompose", f"WITH {DAILY_SQL}, src AS (SELECT * FROM daily), {_decompose_sql(7)}")
def seasonal_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decompose(daily(spark, sf_dir), 86_400, 7, 512)


@query("seasonal_decompose_year", f"WITH {DAILY_SQL}, src AS (SELECT * FROM daily), {_decompose_sql(365)}")
def seasonal_decompose_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decompose(daily(spark, sf_dir), 86_400, 365, 1024)


@query("seasonal_decompose_even", f"WITH {E1H_SQL}, src AS (SELECT series_id, ts, v_sum AS v FROM e1h), {_decompose_sql(24)}")
def seasonal_decompose_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decompose(hourly(spark, sf_dir).select("series_id", "ts", F.col("v_sum").alias("v")), 3600, 24, 256)


_SEG = 256


@query("welch_psd", f"""WITH {E10_SQL}, f AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
    coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM e10),
  s AS (SELECT series_id, seg, i - seg * {_SEG // 2} AS j, v FROM (SELECT series_id, i, v, unnest([i // {_SEG // 2}, i // {_SEG // 2} - 1]) AS seg FROM f) WHERE seg >= 0),
  c AS (SELECT *, count(*) OVER (PARTITION BY series_id, seg) AS n, avg(v) OVER (PARTITION BY series_id, seg) AS m FROM s),
  w AS (SELECT series_id, seg, j, (v - m) * (0.5 - 0.5 * cos(2 * pi() * j / {_SEG})) AS x FROM c WHERE n = {_SEG}),
  p AS (SELECT series_id, seg, k.bin, pow(sum(x * cos(2 * pi() * (k.bin * j % {_SEG}) / {_SEG})), 2) + pow(sum(x * sin(2 * pi() * (k.bin * j % {_SEG}) / {_SEG})), 2) AS a FROM w CROSS JOIN generate_series(0, {_SEG // 2}) k(bin) GROUP BY 1, 2, 3)
  SELECT series_id, bin, {R(f"avg(a) * CASE WHEN bin IN (0, {_SEG // 2}) THEN 1 ELSE 2 END / (6.0 * {_SEG * 3 / 8})", 4)} AS psd, count(*) AS n_segments, {R(f'bin * 6.0 / {_SEG}')} AS frequency FROM p GROUP BY 1, 2""")
def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_edges(ten_minutes(spark, sf_dir), key=KEY, ts="ts", cols=["v"], block_s=WEEK)
    return tidy(spectrum.welch(cut_lineage(indexed(filled, 600)), key=KEY, index="i", value="v", n=_SEG, fs=6.0), 6, psd=4)
