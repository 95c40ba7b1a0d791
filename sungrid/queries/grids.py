"""Resampling, alignment, filling, joining and row windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.measures import correlation
from ..functions.timecols import floor_ts, step_index
from ..operators import grid, joins, windows
from ..operators.blocks import block_seconds, row_index
from ..operators.metrics import basic
from ..operators.stats import linear_fit
from .base import (
    DAILY_SQL, E10_SQL, E1H_SQL, EV_SQL, KEY, P2_SQL, PAIR_SQL, R, WEEK, daily, hourly, observations, pairs, query, readings, rounded,
    scored, table, ten_minutes, tidy,
)
from .columns import CYCLE_SQL, ZONE, cyclical_columns

YEAR = 365 * 86_400
VALUES = ["v_mean", "v_sum", "v_max", "v_last"]


@query("resample_hourly", f"WITH {E1H_SQL} SELECT series_id, ts, {rounded(*VALUES)}, {CYCLE_SQL} FROM e1h")
def resample_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hourly(spark, sf_dir).withColumns(cyclical_columns()))


@query("resample_origin_start", f"""WITH {EV_SQL}, s AS (SELECT series_id, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM ev GROUP BY 1),
  g AS (SELECT series_id, unnest(generate_series(lo, hi, 10800000000)) AS us FROM s),
  b AS (SELECT e.series_id, s.lo + (epoch_us(e.ts) - s.lo) // 10800000000 * 10800000000 AS us, value FROM ev e JOIN s USING (series_id))
  SELECT g.series_id, make_timestamp(g.us) AS ts, {R('avg(value)')} AS v_mean, {R('coalesce(sum(value), 0)')} AS v_sum FROM g LEFT JOIN b USING (series_id, us) GROUP BY 1, 2""")
def resample_origin_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"v_mean": ("value", "mean"), "v_sum": ("value", "sum")}
    return tidy(grid.resample_from_start(readings(spark, sf_dir).select("series_id", "ts", "value"), key=KEY, ts="ts", step_s=10_800, aggs=aggs))


@query("upsample_linear", f"""WITH {E1H_SQL}, k AS (SELECT series_id, ts, v_mean AS v FROM e1h WHERE v_mean IS NOT NULL),
  q AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM e1h GROUP BY 1)
  SELECT q.series_id, q.ts, {R('CASE WHEN p.ts = n.ts OR n.ts IS NULL THEN p.v ELSE p.v + (n.v - p.v) * (epoch_us(q.ts) - epoch_us(p.ts))::DOUBLE / (epoch_us(n.ts) - epoch_us(p.ts)) END')} AS v_mean
  FROM q ASOF LEFT JOIN k p ON q.series_id = p.series_id AND q.ts >= p.ts ASOF LEFT JOIN k n ON q.series_id = n.series_id AND q.ts <= n.ts""")
def upsample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grid.upsample_linear(hourly(spark, sf_dir), key=KEY, ts="ts", cols=["v_mean"], step_s=900, block_s=WEEK))


@query("time_spine", f"""WITH {EV_SQL}, b AS (SELECT series_id, time_bucket(INTERVAL 10 MINUTE, min(ts)) AS lo, time_bucket(INTERVAL 10 MINUTE, max(ts) + INTERVAL 10 MINUTE - INTERVAL 1 MICROSECOND) AS hi FROM ev GROUP BY 1)
  SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 10 MINUTE)) AS ts FROM b""")
def time_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.time_spine(readings(spark, sf_dir), key=KEY, ts="ts", step_s=600)


def nearest_sql(source: str, grid_: str, value: str, out: str) -> str:
    """Value of ``source`` nearest to each time of ``grid_``; the later on a tie."""
    return f"""SELECT g.series_id, g.ts, CASE WHEN p.ts IS NULL OR epoch_us(n.ts) - epoch_us(g.ts) <= epoch_us(g.ts) - epoch_us(p.ts) THEN n.{value} ELSE p.{value} END AS {out}
  FROM {grid_} g ASOF LEFT JOIN {source} p ON g.series_id = p.series_id AND g.ts >= p.ts ASOF LEFT JOIN {source} n ON g.series_id = n.series_id AND g.ts <= n.ts"""


_HOUR_GRID = "SELECT series_id, unnest(generate_series(date_trunc('hour', min(ts)), time_bucket(INTERVAL 1 HOUR, max(ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS ts FROM {} GROUP BY 1"


@query("reindex_nearest", f"""WITH k AS (SELECT event_type AS series_id, ts, value FROM events), g0 AS ({_HOUR_GRID.format('k')}),
  r AS ({nearest_sql('k', 'g0', 'value', 'value')}) SELECT series_id, ts, {R('value')} AS value FROM r""")
def reindex_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return tidy(grid.reindex_nearest(e, key=KEY, ts="ts", cols=["value"], step_s=3600, block_s=block_seconds(e, key=KEY, ts="ts", longest=WEEK)))


_SPAN_SQL = """l AS (SELECT series_id, ts, ghi FROM obs WHERE ghi IS NOT NULL), r AS (SELECT series_id, ts, precip FROM obs WHERE precip IS NOT NULL),
  span AS (SELECT series_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM l GROUP BY 1) a
    JOIN (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM r GROUP BY 1) b USING (series_id))"""


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, sf_dir)
    return tuple(obs.where(F.col(c).isNotNull()).select("series_id", "ts", c) for c in ("ghi", "precip"))


@query("common_range", f"WITH {PAIR_SQL}, {_SPAN_SQL} SELECT series_id, ts, {R('ghi')} AS ghi FROM l JOIN span USING (series_id) WHERE ts BETWEEN lo AND hi")
def common_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_sources(spark, sf_dir)
    return tidy(grid.clip_to_range(left, grid.common_range(left, right, key=KEY, ts="ts"), key=KEY, ts="ts"))


@query("ffill_bfill", f"""WITH {E10_SQL} SELECT series_id, ts, {R('coalesce(last_value(v IGNORE NULLS) OVER w, first_value(v IGNORE NULLS) OVER u)')} AS v FROM e10
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grid.fill_edges(ten_minutes(spark, sf_dir), key=KEY, ts="ts", cols=["v"], block_s=WEEK))


@query("impute_range", f"""WITH {PAIR_SQL}, f AS (SELECT series_id, regr_slope(power, ghi) AS slope, regr_intercept(power, ghi) AS intercept FROM pair GROUP BY 1),
  h AS (SELECT p.*, slope, intercept, ((p.ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' AND ghi IS NOT NULL AS hit FROM pair p JOIN f USING (series_id))
  SELECT series_id, ts, {R('ghi')} AS ghi, {R('CASE WHEN hit THEN greatest(intercept + slope * ghi, 0) ELSE power END')} AS power, hit::BIGINT AS imputed FROM h""")
def impute_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir).select("series_id", "ts", "ghi", "power")
    line = linear_fit(df, key=KEY, x="ghi", y="power")
    return tidy(grid.impute_range(df, line, key=KEY, ts="ts", target="power", driver="ghi", zone=ZONE, first_day="2024-01-10", last_day="2024-01-14"))


_SUB = [f"v_{s}" for s in ("mean", "max", "min", "std", "sum")]


def _filled(c: str) -> str:
    return R(f"coalesce(last_value({c} IGNORE NULLS) OVER w, first_value({c} IGNORE NULLS) OVER u)") + f" AS {c}"


@query("subhourly_stats", f"""WITH {E10_SQL}, h AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(v) AS v_mean, max(v) AS v_max, min(v) AS v_min, stddev_samp(v) AS v_std, coalesce(sum(v), 0) AS v_sum FROM e10 GROUP BY 1, 2)
  SELECT series_id, ts, {', '.join(_filled(c) for c in _SUB)} FROM h
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def subhourly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = hourly(spark, sf_dir).select("series_id", "ts")
    out = grid.subhourly_stats(ten_minutes(spark, sf_dir), hours, key=KEY, ts="ts", stats={"v": ["mean", "max", "min", "std", "sum"]}, block_s=WEEK)
    return tidy(out)


@query("daily_mean", f"WITH {E1H_SQL} SELECT series_id, ts::DATE AS day, {R('avg(v_mean)')} AS v_mean FROM e1h GROUP BY 1, 2")
def daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hourly(spark, sf_dir).groupBy("series_id", F.to_date("ts").alias("day")).agg(F.avg("v_mean").alias("v_mean")))


@query("monthly_energy_cumulative", f"""WITH {DAILY_SQL}, m AS (SELECT series_id, date_trunc('month', ts)::DATE AS month, sum(v) / 1000 AS energy_k FROM daily GROUP BY 1, 2)
  SELECT series_id, month, {R('energy_k')} AS energy_k, {R('sum(energy_k) OVER (PARTITION BY series_id ORDER BY month)')} AS energy_k_total FROM m""")
def monthly_energy_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grid.monthly_energy(daily(spark, sf_dir), key=KEY, ts="ts", power="v"))


@query("daily_energy", f"WITH {EV_SQL} SELECT series_id, ts::DATE AS day, {R('sum(value) / 1000')} AS energy_kwh FROM ev GROUP BY 1, 2")
def daily_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grid.daily_energy(readings(spark, sf_dir), key=KEY, ts="ts", energy="value"))


@query("trim_to_first_positive", f"""WITH {EV_SQL}, f AS (SELECT series_id, min(ts) AS first_positive FROM ev WHERE value > 250 GROUP BY 1)
  SELECT series_id, first_positive, event_id, ts, {R('value - 250')} AS x FROM ev JOIN f USING (series_id) WHERE ts >= first_positive""")
def trim_to_first_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readings(spark, sf_dir).select("series_id", "event_id", "ts", (F.col("value") - 250).alias("x"))
    return tidy(grid.trim_to_first_positive(df, key=KEY, ts="ts", value="x"))


@query("infer_step", f"""WITH {E10_SQL}, d AS (SELECT series_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM e10 WHERE v IS NOT NULL),
  c AS (SELECT series_id, d, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1, 2)
  SELECT series_id, {R('d / 1000000')} AS step_s, n AS n_steps FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, d) = 1""")
def infer_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(grid.infer_step(ten_minutes(spark, sf_dir).where("v IS NOT NULL"), key=KEY, ts="ts", block_s=WEEK))


@query("resolution_loss", f"""WITH {E10_SQL}, a AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(v) AS x FROM e10 GROUP BY 1, 2),
  b AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(value) AS y FROM ev GROUP BY 1, 2)
  SELECT series_id, count(x - y) AS n, {R('sqrt(avg((y - x) * (y - x)))')} AS rmse, {R('avg(abs(y - x))')} AS mae, {R('corr(x, y)')} AS r FROM a JOIN b USING (series_id, ts) GROUP BY 1""")
def resolution_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = grid.resample(ten_minutes(spark, sf_dir), key=KEY, ts="ts", step_s=3600, aggs={"x": ("v", "mean")}, empty_bins=False)
    native = grid.resample(readings(spark, sf_dir), key=KEY, ts="ts", step_s=3600, aggs={"y": ("value", "mean")}, empty_bins=False)
    both = fine.join(native, ["series_id", "ts"])
    m = basic(F.col("y"), F.col("x"))
    return tidy(both.groupBy("series_id").agg(*[m[c].alias(c) for c in ("n", "rmse", "mae")], correlation(F.col("x"), F.col("y")).alias("r")))


# --- Joins and unions -------------------------------------------------------------

def _source_sql(name: str, col: str) -> str:
    return f"{name} AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg({col}) AS {col} FROM obs WHERE {col} IS NOT NULL GROUP BY 1, 2)"


def _source(spark: SparkSession, sf_dir: str, col: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(F.col(col).isNotNull())
    return grid.resample(rows, key=KEY, ts="ts", step_s=3600, aggs={col: (col, "mean")}, empty_bins=False)


_SOURCES_SQL = f"{PAIR_SQL}, {_source_sql('sa', 'ghi')}, {_source_sql('sb', 'power')}, {_source_sql('sc', 'precip')}"


@query("join_outer_dropna", f"""WITH {_SOURCES_SQL}, j AS (SELECT * FROM sa FULL JOIN sb USING (series_id, ts) FULL JOIN sc USING (series_id, ts))
  SELECT series_id, ts, {rounded('ghi', 'power', 'precip')} FROM j WHERE ghi IS NOT NULL AND power IS NOT NULL AND precip IS NOT NULL""")
def join_outer_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [_source(spark, sf_dir, c) for c in ("ghi", "power", "precip")]
    return tidy(joins.outer_then_complete(sources, on=["series_id", "ts"]))


@query("join_left", f"WITH {_SOURCES_SQL} SELECT p.series_id, p.ts, {R('p.ghi')} AS ghi, {R('sc.precip')} AS precip FROM pair p LEFT JOIN sc USING (series_id, ts)")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pairs(spark, sf_dir).select("series_id", "ts", "ghi").join(_source(spark, sf_dir, "precip"), ["series_id", "ts"], "left"))


@query("asof_nearest_join", f"""WITH {PAIR_SQL}, {_SPAN_SQL}, g0 AS (SELECT series_id, unnest(generate_series(date_trunc('hour', lo), time_bucket(INTERVAL 1 HOUR, hi + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS ts FROM span),
  a AS ({nearest_sql('l', 'g0', 'ghi', 'ghi')}), b AS ({nearest_sql('r', 'g0', 'precip', 'precip')}) SELECT series_id, ts, {rounded('ghi', 'precip')} FROM a JOIN b USING (series_id, ts)""")
def asof_nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_sources(spark, sf_dir)
    span = grid.common_range(left, right, key=KEY, ts="ts")
    ends = span.select("series_id", floor_ts(F.col("lo"), 3600).alias("lo"), grid.ceil_ts(F.col("hi"), 3600).alias("hi"))
    times = grid.spine_between(ends, key=KEY, low="lo", high="hi", step_s=3600)
    return tidy(joins.asof_nearest(left, right, times, key=KEY, ts="ts", left_cols=["ghi"], right_cols=["precip"], step_s=3600,
                                   block_s=block_seconds(left.unionByName(right, allowMissingColumns=True), key=KEY, ts="ts", longest=WEEK)))


_LISTED = "(SELECT DISTINCT ts::DATE AS day FROM events WHERE value > 300)"


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    return e, e.where(F.col("value") > 300).select("day").distinct()


@query("semi_dates", f"SELECT event_id, ts::DATE AS day, value FROM events WHERE ts::DATE IN {_LISTED}")
def semi_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, days = _days(spark, sf_dir)
    return joins.keep_days(e, days, day="day")


@query("anti_dates", f"SELECT event_id, ts::DATE AS day, value FROM events WHERE ts::DATE NOT IN {_LISTED}".replace("> 300", "> 420"))
def anti_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _days(spark, sf_dir)
    return joins.drop_days(e, e.where(F.col("value") > 420).select("day").distinct(), day="day")


@query("compare_models", f"""WITH {P2_SQL} SELECT count(*) AS n, {R('avg(abs(y_true - y_pred))')} AS mean_abs_diff, {R('max(abs(y_true - y_pred))')} AS max_abs_diff,
  {R('(avg(y_pred) - avg(y_true)) * 100 / avg(y_true)')} AS relative_mean_pct FROM p2""")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p2 = scored(spark, sf_dir)
    a, b = (p2.select("series_id", "ts", F.col(c).alias("power")) for c in ("y_true", "y_pred"))
    return tidy(joins.compare_results(a, b, on=["series_id", "ts"], value="power"))


@query("union_sources", f"""WITH {_SOURCES_SQL} SELECT series_id, ts, {R('ghi')} AS ghi, NULL::DOUBLE AS precip, 'view' AS source FROM sa UNION ALL SELECT series_id, ts, NULL, {R('precip')}, 'error' FROM sc""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _source(spark, sf_dir, "ghi").withColumn("source", F.lit("view"))
    b = _source(spark, sf_dir, "precip").withColumn("source", F.lit("error"))
    return tidy(joins.union_all([a, b]))


@query("dedup_keep_first", f"""WITH f AS (SELECT CASE WHEN o_orderkey % 1000 <> 0 THEN o_orderdate::DATE END AS day, o_orderpriority AS source_file, o_orderkey, o_totalprice AS energy_kwh FROM orders)
  SELECT day, source_file, o_orderkey, {R('energy_kwh')} AS energy_kwh FROM f QUALIFY row_number() OVER (PARTITION BY day ORDER BY source_file, o_orderkey) = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 1000 != 0, F.to_date("o_orderdate")).alias("day")
    files = table(spark, sf_dir, "orders").select(day, F.col("o_orderpriority").alias("source_file"), "o_orderkey", F.col("o_totalprice").alias("energy_kwh"))
    return tidy(joins.keep_first(files, key=["day"], order=["source_file", "o_orderkey"]))


@query("union_distinct_ts", f"WITH {_SOURCES_SQL} SELECT ts FROM sa UNION SELECT ts FROM sb")
def union_distinct_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    hours = [obs.where(F.col(c).isNotNull()).select(floor_ts(F.col("ts"), 3600).alias("ts")) for c in ("ghi", "power")]
    return joins.union_all(hours).distinct()


# --- Row windows ------------------------------------------------------------------

def indexed(df: DataFrame, step_s: int) -> DataFrame:
    return df.withColumn("i", step_index(F.col("ts"), step_s))


_ROLL = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_W30, _W24 = _ROLL.format(29), _ROLL.format(23)


@query("rolling_mean_std", f"""WITH {DAILY_SQL} SELECT series_id, ts, {R('v')} AS v, {R(f'CASE WHEN count(v) {_W30} = 30 THEN avg(v) {_W30} END')} AS v_mean,
  {R(f'CASE WHEN count(v) {_W30} = 30 THEN stddev_samp(v) {_W30} END')} AS v_std FROM daily""")
def rolling_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.rolling(indexed(daily(spark, sf_dir), 86_400), key=KEY, index="i", col="v", n=30, rows=512)
    return tidy(out.drop("i"))


@query("rolling_corr", f"""WITH {PAIR_SQL}, z AS (SELECT series_id, ts, coalesce(ghi, 0) AS a, coalesce(power, 0) AS b FROM pair)
  SELECT series_id, ts, {R(f'CASE WHEN count(*) {_W24} = 24 AND max(a) {_W24} > min(a) {_W24} AND max(b) {_W24} > min(b) {_W24} THEN corr(a, b) {_W24} END')} AS r FROM z""")
def rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indexed(pairs(spark, sf_dir).select("series_id", "ts", "ghi", "power").fillna(0.0), 3600)
    return tidy(windows.rolling_corr(df, key=KEY, index="i", a="ghi", b="power", n=24, name="r", rows=256).select("series_id", "ts", "r"))


@query("first_diff", f"WITH {E1H_SQL} SELECT series_id, ts, {R('v_sum - lag(v_sum) OVER (PARTITION BY series_id ORDER BY ts)')} AS diff FROM e1h")
def first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.difference(hourly(spark, sf_dir).select("series_id", "ts", "v_sum"), key=KEY, ts="ts", col="v_sum", name="diff", block_s=WEEK)
    return tidy(out.select("series_id", "ts", "diff"))


N = 24
_SEQ_SQL = f"""{PAIR_SQL}, z AS (SELECT series_id, ts, coalesce(ghi, 0) AS ghi, coalesce(temp, 0) AS temp, coalesce(power, 0) AS power, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM pair),
  seq AS (SELECT series_id, ts, rn, power, count(*) {_W24} AS c, first_value(ghi) {_W24} AS ghi_first, ghi AS ghi_last, sum(ghi * rn) {_W24} - (rn - {N}) * sum(ghi) {_W24} AS ghi_weighted, sum(temp) {_W24} AS temp_sum,
    lead(ts) OVER o AS next_ts, lead(power) OVER o AS next_power FROM z WINDOW o AS (PARTITION BY series_id ORDER BY ts))"""
_PRINT = f"{R('ghi_first')} AS ghi_first, {R('ghi_last')} AS ghi_last, {R('ghi_weighted', 4)} AS ghi_weighted, {R('temp_sum', 4)} AS temp_sum"


def sequence_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(pairs(spark, sf_dir).select("series_id", "ts", "ghi", "temp", "power").fillna(0.0), 3600)


def _sequences(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return windows.sequences(sequence_input(spark, sf_dir), key=KEY, index="i", ts="ts", features=["ghi", "temp"], n=N, rows=256, **how)


def _content(seq: DataFrame, *cols: str) -> DataFrame:
    """What a window holds, as numbers that depend on every step and its place."""
    x = F.col("x")
    total = lambda f: F.aggregate(F.transform(x, f), F.lit(0.0), lambda a, b: a + b)
    parts: dict[str, Column] = {
        "ghi_first": F.element_at(x, 1)["ghi"], "ghi_last": F.element_at(x, -1)["ghi"],
        "ghi_weighted": total(lambda r, i: r["ghi"] * (i + 1)), "temp_sum": total(lambda r: r["temp"])}
    return tidy(seq.select(*cols, *[c.alias(n) for n, c in parts.items()]), 6, ghi_weighted=4, temp_sum=4)


@query("sequences_next", f"WITH {_SEQ_SQL} SELECT series_id, next_ts AS target_ts, {R('next_power')} AS y, {_PRINT} FROM seq WHERE c = {N} AND next_ts IS NOT NULL")
def sequences_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_sequences(spark, sf_dir, target="power", next_step=True), "series_id", "target_ts", "y")


@query("sequences_same", f"WITH {_SEQ_SQL} SELECT series_id, ts AS target_ts, {R('power')} AS y, {_PRINT} FROM seq WHERE c = {N}")
def sequences_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_sequences(spark, sf_dir, target="power", next_step=False), "series_id", "target_ts", "y")


@query("sequences_infer", f"""WITH {_SEQ_SQL} SELECT series_id, ts AS target_ts, {', '.join(f'CASE WHEN c = {N} THEN {c} END AS {c}' for c in ('ghi_first', 'ghi_last', 'ghi_weighted', 'temp_sum'))}
  FROM (SELECT series_id, ts, c, {_PRINT} FROM seq)""")
def sequences_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_sequences(spark, sf_dir, target=None, next_step=False, keep_short=True), "series_id", "target_ts")


@query("align_predictions", f"WITH {_SEQ_SQL} SELECT series_id, rn - {N + 1} AS k, ts AS target_ts, {R('power')} AS y, TRUE::BIGINT AS aligned FROM seq WHERE rn > {N}")
def align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Prediction k belongs to row n + k: numbered windows against numbered rows.
    rows = row_index(sequence_input(spark, sf_dir).select("series_id", "ts"), key=KEY, ts="ts", block_s=WEEK)
    seq = _sequences(spark, sf_dir, target="power", next_step=True).select("series_id", "target_ts", "y")
    seq = row_index(seq, key=KEY, ts="target_ts", block_s=WEEK, name="k")
    at = rows.select("series_id", (F.col("rn") - N).alias("k"), F.col("ts").alias("_ts"))
    return tidy(seq.join(at, ["series_id", "k"]).select("series_id", "k", "target_ts", "y", (F.col("_ts") == F.col("target_ts")).cast("long").alias("aligned")))


@query("first_sample_per_slot", f"""WITH {EV_SQL} SELECT series_id, hour(ts) AS hour, minute(ts) AS minute, ts, event_id FROM ev
  QUALIFY row_number() OVER (PARTITION BY series_id, hour(ts), minute(ts) ORDER BY ev.ts) = 1""")
def first_sample_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_per_slot(readings(spark, sf_dir), key=KEY, ts="ts", values=["event_id"])
