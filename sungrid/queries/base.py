"""Registry of queries, and the series that they derive from the tables.

Each query is registered with the SQL that gives the same rows. Doubles are
rounded on both sides, after a small shift that keeps decimal ties (means of
two-decimal numbers) from falling to either side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.timecols import floor_ts
from ..operators.grid import resample
from ..operators.model import predict_line
from ..operators.blocks import row_index
from ..operators.stats import linear_fit
from ..session import cut_lineage, use_utc

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

WEEK = 7 * 86_400
KEY = ["series_id"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is already registered")
        REGISTRY[name] = (fn, sql)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles and widen integers; ``special`` gives digits per column."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            d = special.get(f.name, digits)
            c = F.round(c + F.lit(0.033 * 10.0**-d), d)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def R(expr: str, digits: int = 6) -> str:
    """The SQL form of ``tidy`` for one double."""
    return f"round(({expr})::DOUBLE + {0.033 * 10.0**-digits!r}, {digits})"


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{R(n, digits)} AS {n}" for n in names)


# --- Readings: events by type. Every seventh value is missing. ---------------

EV_SQL = """ev AS (
  SELECT event_id, event_type AS series_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return e.select("event_id", F.col("event_type").alias("series_id"), "ts", "user_id", value.alias("value"))


def _grid_sql(name: str, step: str, trunc: str, measures: str) -> str:
    return f"""{EV_SQL},
{name}_b AS (SELECT series_id, {trunc.format('min(ts)')} AS lo, {trunc.format('max(ts)')} AS hi FROM ev GROUP BY 1),
{name}_s AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL {step})) AS ts FROM {name}_b),
{name} AS (SELECT s.series_id, s.ts, {measures} FROM {name}_s s
  LEFT JOIN ev e ON e.series_id = s.series_id AND {trunc.format('e.ts')} = s.ts GROUP BY 1, 2)"""


HOURLY = {"v_mean": ("value", "mean"), "v_sum": ("value", "sum"), "v_max": ("value", "max"), "v_last": ("value", "last")}
E1H_SQL = _grid_sql("e1h", "1 HOUR", "date_trunc('hour', {})",
                    "avg(value) AS v_mean, coalesce(sum(value), 0) AS v_sum, max(value) AS v_max, "
                    "arg_max(value, e.ts) FILTER (value IS NOT NULL) AS v_last")
E10_SQL = _grid_sql("e10", "10 MINUTE", "time_bucket(INTERVAL 10 MINUTE, {})", "avg(value) AS v")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(readings(spark, sf_dir), key=KEY, ts="ts", step_s=3600, aggs=HOURLY)


def ten_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(readings(spark, sf_dir), key=KEY, ts="ts", step_s=600, aggs={"v": ("value", "mean")})


# --- Feature and target columns of two sites, hourly on a full grid. ----------

ROLES = {"ghi": "view", "power": "click", "temp": "purchase", "wind": "signup", "precip": "error"}
PAIR_SQL = f"""obs AS (SELECT 'site_' || (user_id % 2) AS series_id, ts,
  {', '.join(f"CASE WHEN event_type = '{t}' THEN value END AS {c}" for c, t in ROLES.items())} FROM events),
pair_b AS (SELECT series_id, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM obs GROUP BY 1),
pair_s AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM pair_b),
pair AS (SELECT s.series_id, s.ts, {', '.join(f'avg({c}) AS {c}' for c in ROLES)} FROM pair_s s
  LEFT JOIN obs o ON o.series_id = s.series_id AND date_trunc('hour', o.ts) = s.ts GROUP BY 1, 2)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    site = F.concat(F.lit("site_"), (F.col("user_id") % 2).cast("string")).alias("series_id")
    return e.select(site, "ts", *[F.when(F.col("event_type") == t, F.col("value")).alias(c) for c, t in ROLES.items()])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(observations(spark, sf_dir), key=KEY, ts="ts", step_s=3600, aggs={c: (c, "mean") for c in ROLES})


# --- Scored rows: power against a line on ghi, fitted on the first 70 %. -------

P2_SQL = f"""{PAIR_SQL},
p2_n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n
  FROM pair WHERE ghi IS NOT NULL AND power IS NOT NULL),
p2_f AS (SELECT series_id, regr_slope(power, ghi) AS slope, regr_intercept(power, ghi) AS intercept
  FROM p2_n WHERE rn < floor(n * 0.7::DOUBLE) GROUP BY 1),
p2 AS (SELECT p.series_id, p.ts, p.rn, p.n, p.ghi, p.power AS y_true, f.intercept + f.slope * p.ghi AS y_pred
  FROM p2_n p LEFT JOIN p2_f f USING (series_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pairs(spark, sf_dir).dropna(subset=["ghi", "power"]).select("series_id", "ts", "ghi", "power")
    rows = cut_lineage(row_index(known, key=KEY, ts="ts", block_s=WEEK, total="n"))  # the fit and its use read it
    fit = linear_fit(rows.where(F.col("rn") < F.floor(F.col("n") * 0.7)), key=KEY, x="ghi", y="power")
    # A series too short to fit keeps its rows, without predictions.
    return predict_line(rows, fit, key=KEY, x="ghi", name="y_pred").withColumnRenamed("power", "y_true")


# --- Days: shipped value per day and return flag, on a full grid. --------------

DAILY_SQL = """daily_b AS (SELECT l_returnflag AS series_id, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1),
daily_s AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM daily_b),
daily AS (SELECT s.series_id, s.ts, coalesce(sum(l_extendedprice), 0) / 1000 AS v FROM daily_s s
  LEFT JOIN lineitem l ON l.l_returnflag = s.series_id AND l.l_shipdate = s.ts GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("v"))
    return resample(li, key=KEY, ts="ts", step_s=86_400, aggs={"v": ("v", "sum")}).withColumn("v", F.col("v") / 1000)


# --- Sites: every line item is an observation at its supplier's place. ---------

SITES_SQL = """sites AS (SELECT l_orderkey, l_linenumber,
  l_shipdate + ((l_orderkey * 37 + l_linenumber * 211) % 1440)::INTEGER * INTERVAL 1 MINUTE AS ts,
  (35 + s_nationkey)::DOUBLE AS lat, (s_suppkey % 25)::DOUBLE AS lon, (s_suppkey % 10 * 100)::DOUBLE AS alt,
  l_quantity AS temp_c, l_tax * 100 AS wind_ms, l_extendedprice / 100 AS direct, l_discount * 1000 AS diffuse,
  CASE WHEN l_linenumber <> 1 THEN 950 + l_quantity END AS pressure_hpa
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    minute = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 211) % 1440).cast("long")
    at = F.col("l_shipdate") + F.make_dt_interval(mins=minute.cast("int"))
    return li.join(su, F.col("s_suppkey") == F.col("l_suppkey")).select(
        "l_orderkey", "l_linenumber", at.alias("ts"),
        (F.lit(35) + F.col("s_nationkey")).cast("double").alias("lat"), (F.col("s_suppkey") % 25).cast("double").alias("lon"),
        (F.col("s_suppkey") % 10 * 100).cast("double").alias("alt"), F.col("l_quantity").alias("temp_c"),
        (F.col("l_tax") * 100).alias("wind_ms"), (F.col("l_extendedprice") / 100).alias("direct"),
        (F.col("l_discount") * 1000).alias("diffuse"),
        F.when(F.col("l_linenumber") != 1, F.lit(950) + F.col("l_quantity")).alias("pressure_hpa"))
