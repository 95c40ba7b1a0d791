"""Cleaning, time and solar columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clean, solar, timecols as tc
from ..operators.blocks import block_seconds
from ..operators.joins import last_rows
from ..operators.splits import sample_rows
from ..operators.windows import deaccumulate
from .base import E1H_SQL, EV_SQL, KEY, PAIR_SQL, R, SITES_SQL, WEEK, hourly, pairs, query, readings, rounded, sites, table, tidy

ZONE = "Europe/Vienna"
ROW = ["l_orderkey", "l_linenumber"]


@query("energy_to_power", f"SELECT event_id, {R('value * 12')} AS power_w FROM events")
def energy_to_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(table(spark, sf_dir, "events").select("event_id", clean.energy_to_power(F.col("value")).alias("power_w")))


@query("wind_speed_uv", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {R('sqrt(l_quantity * l_quantity + l_tax * 100 * (l_tax * 100))')} AS wind_ms FROM lineitem")
def wind_speed_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return tidy(li.select(*ROW, clean.magnitude(F.col("l_quantity"), F.col("l_tax") * 100).alias("wind_ms")))


@query("quality_filter", f"""SELECT event_id, ts, value FROM events
  WHERE CASE WHEN event_id % 5 = 0 THEN 10 ELSE 12 END = 12 AND CASE WHEN user_id % 4 = 0 THEN 20 ELSE 12 END = 12""")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", "value", F.when(F.col("event_id") % 5 == 0, 10).otherwise(12).alias("cglo_flag"),
        F.when(F.col("user_id") % 4 == 0, 20).otherwise(12).alias("tl_flag"))
    return clean.keep_good(e, ["cglo_flag", "tl_flag", "ff_flag"]).select("event_id", "ts", "value")


@query("dropna_any", f"WITH {PAIR_SQL} SELECT series_id, ts, {rounded('ghi', 'power')} FROM pair WHERE ghi IS NOT NULL AND power IS NOT NULL")
def dropna_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pairs(spark, sf_dir).select("series_id", "ts", "ghi", "power").dropna(how="any"))


@query("decimate_minute", "SELECT event_id, event_type, ts, value FROM events WHERE minute(ts) = 10")
def decimate_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.minute("ts") == 10).select("event_id", "event_type", "ts", "value")


@query("time_slice", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-16 23:59:59'")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 00:00:00", "2024-01-16 23:59:59"))
    return table(spark, sf_dir, "events").where(F.col("ts").between(low, high)).select("event_id", "ts", "value")


@query("last_n_per_series", """SELECT event_type AS series_id, ts, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 24""")
def last_n_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return last_rows(e, key=KEY, ts="ts", n=24, tie=["event_id"], block_s=block_seconds(e, key=KEY, ts="ts", longest=WEEK))


@query("coerce_numeric", f"""SELECT event_id, {R("TRY_CAST(CASE event_id % 3 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'n/a' ELSE props END AS DOUBLE)")} AS x,
  TRY_CAST(CASE event_id % 2 WHEN 0 THEN user_id::VARCHAR ELSE event_type END AS BIGINT) AS k FROM events""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.col("value").cast("string")).when(i % 3 == 1, "n/a").otherwise(F.col("props"))
    label = F.when(i % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return tidy(table(spark, sf_dir, "events").select("event_id", clean.coerce_double(text).alias("x"), label.try_cast("bigint").alias("k")))


@query("parse_german_ts", """SELECT o_orderkey,
  try_strptime(CASE WHEN o_orderkey % 10 = 0 THEN 'am ' ELSE '' END || strftime(o_orderdate + (o_orderkey % 1440)::INTEGER * INTERVAL 1 MINUTE, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') AS ts,
  try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END, '%d.%m.%Y')::DATE AS day FROM orders""")
def parse_german_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    minute = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "am ").otherwise(""), F.date_format(at, "dd.MM.yyyy HH:mm"))
    day = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o.select("o_orderkey", tc.parse_ts(minute, "dd.MM.yyyy HH:mm").alias("ts"), F.to_date(tc.parse_ts(day, "dd.MM.yyyy")).alias("day"))


@query("local_to_utc_dst", f"""WITH t AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_shipdate + ((l_orderkey * 7 + l_linenumber) % 6 * 30 + 60)::INTEGER * INTERVAL 1 MINUTE AS local_ts FROM lineitem),
  u AS (SELECT *, (local_ts AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS utc FROM t)
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, local_ts, CASE WHEN (utc AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' = local_ts
    AND ((utc + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' <> local_ts
    AND ((utc - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' <> local_ts THEN utc END AS utc_ts FROM u""")
def local_to_utc_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    mins = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 6 * 30 + 60).cast("int")
    li = table(spark, sf_dir, "lineitem").select(*ROW, (F.col("l_shipdate") + F.make_dt_interval(mins=mins)).alias("local_ts"))
    return tidy(li.withColumn("utc_ts", tc.local_to_utc(F.col("local_ts"), ZONE)))


@query("utc_to_local", f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS local_ts FROM
  (SELECT *, l_shipdate + (l_orderkey % 24)::INTEGER * INTERVAL 1 HOUR AS ts FROM lineitem)""")
def utc_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    li = table(spark, sf_dir, "lineitem").select(*ROW, at.alias("ts"))
    return tidy(li.withColumn("local_ts", tc.utc_to_local(F.col("ts"), ZONE)))


@query("floor_ceil_ts", """SELECT event_id, ts::DATE AS day, time_bucket(INTERVAL 15 MINUTE, ts) AS floor_15,
  time_bucket(INTERVAL 15 MINUTE, ts + INTERVAL 15 MINUTE - INTERVAL 1 MICROSECOND) AS ceil_15, date_trunc('hour', ts) AS floor_hour FROM events""")
def floor_ceil_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.to_date(ts).alias("day"), tc.floor_ts(ts, 900).alias("floor_15"), tc.ceil_ts(ts, 900).alias("ceil_15"),
        tc.floor_ts(ts, 3600).alias("floor_hour"))


def cyclical_columns(ts: str = "ts", year: float = 365.25) -> dict:
    hour, day, month = tc.hour_of_day(F.col(ts)), F.dayofyear(ts), F.month(ts)
    out = {"hour": hour, "day_of_year": day.cast("long")}
    for name, x, period in (("hour", hour, 24.0), ("day", day, year), ("month", month, 12.0)):
        out[f"{name}_sin"], out[f"{name}_cos"] = tc.cyclical(x, period)
    return out


_HOUR = "(hour(ts) + minute(ts) / 60.0)"


def cycle_sql(*names: str) -> str:
    """Hour and day of year, and the sine and cosine of the named cycles."""
    cycles = {"hour": (_HOUR, 24.0), "day": ("dayofyear(ts)", 365.25), "month": ("month(ts)", 12.0)}
    parts = [f"{R(f'{f}({x} * {2 * math.pi / p!r})')} AS {n}_{f}" for n, (x, p) in cycles.items() if n in names for f in ("sin", "cos")]
    return f"{R(_HOUR)} AS hour, dayofyear(ts) AS day_of_year, " + ", ".join(parts)


CYCLE_SQL = cycle_sql("hour", "day", "month")


@query("cyclical_features", f"SELECT event_id, {CYCLE_SQL} FROM events")
def cyclical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(table(spark, sf_dir, "events").withColumns(cyclical_columns()).select("event_id", *cyclical_columns()))


@query("night_flag", f"""WITH {PAIR_SQL} SELECT series_id, ts, (coalesce(ghi, 0) < 10)::BIGINT AS by_ghi, (coalesce(precip, 0) < 1)::BIGINT AS by_second,
  greatest((coalesce(ghi, 0) < 10)::BIGINT, (coalesce(precip, 0) < 1)::BIGINT) AS is_night FROM pair""")
def night_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = pairs(spark, sf_dir).select("series_id", "ts", clean.night_below(F.col("ghi"), 10).alias("by_ghi"), clean.night_below(F.col("precip"), 1).alias("by_second"))
    return tidy(flags.withColumn("is_night", clean.any_flag(F.col("by_ghi"), F.col("by_second"))))


@query("clear_sky_index", f"""WITH {PAIR_SQL} SELECT series_id, ts, {R('CASE WHEN ghi IS NULL AND temp > 10 THEN NULL ELSE least(greatest(CASE WHEN temp > 10 THEN ghi / temp ELSE 0 END, 0), 1.5) END')} AS csi FROM pair""")
def clear_sky_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pairs(spark, sf_dir).select("series_id", "ts", clean.guarded_ratio(F.col("ghi"), F.col("temp"), above=10).alias("csi")))


@query("combine_sources", f"""WITH {PAIR_SQL} SELECT series_id, ts,
  {R('(coalesce(ghi, 0) + coalesce(precip, 0)) / nullif((ghi IS NOT NULL)::INT + (precip IS NOT NULL)::INT, 0)')} AS combined FROM pair""")
def combine_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pairs(spark, sf_dir).select("series_id", "ts", clean.row_mean(F.col("ghi"), F.col("precip")).alias("combined")))


@query("deaccumulate", f"""WITH {E1H_SQL} SELECT series_id, ts, {R('coalesce((v_sum - lag(v_sum) OVER (PARTITION BY series_id ORDER BY ts)) / 3600, 0)')} AS rate FROM e1h""")
def deaccumulate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deaccumulate(hourly(spark, sf_dir).select("series_id", "ts", "v_sum"), key=KEY, ts="ts", col="v_sum", name="rate", block_s=WEEK)
    return tidy(out.select("series_id", "ts", "rate"))


@query("clip_values", f"WITH {EV_SQL} SELECT event_id, {R('CASE WHEN value IS NOT NULL THEN greatest(value - 50, 0) END')} AS low, {R('CASE WHEN value IS NOT NULL THEN least(greatest(value / 100, 0), 1) END')} AS unit FROM ev")
def clip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return tidy(readings(spark, sf_dir).select("event_id", clean.clip(v - 50, low=0).alias("low"), clean.clip(v / 100, 0, 1).alias("unit")))


@query("rated_power_map", f"SELECT event_id, {R('value / 5000.0')} AS fraction, {R('value / 560.21 * 5000.0', 4)} AS power_w FROM events")
def rated_power_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return tidy(table(spark, sf_dir, "events").select("event_id", clean.from_rated(v).alias("fraction"), clean.to_rated(v / 560.21).alias("power_w")), 6, power_w=4)


@query("sample_rows", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem
  ORDER BY ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|42'), 1, 15))::BIGINT, l_orderkey, l_linenumber LIMIT 10000""")
def sample_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), "l_quantity")
    return sample_rows(rows, key=ROW, n=10_000)


@query("fill_zero", f"WITH {PAIR_SQL} SELECT series_id, ts, {R('coalesce(power, 0)')} AS power, {R('ghi')} AS ghi FROM pair")
def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pairs(spark, sf_dir).select("series_id", "ts", "power", "ghi").fillna(0.0, subset=["power"]))


@query("shift_ts", "SELECT event_id, ts - INTERVAL 90 MINUTE AS ts, value FROM events")
def shift_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tc.shift_ts(F.col("ts"), -5400).alias("ts"), "value")


# --- Solar columns --------------------------------------------------------------


def sun_sql(source: str) -> str:
    """The sun's place for rows of ``source`` (ts, lat, lon), as ``sun``."""
    return f"""sun_g AS (SELECT *, (dayofyear(ts) - 1) * {2 * math.pi / 365!r} AS g FROM {source}),
sun_d AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec,
  229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eot FROM sun_g),
sun_h AS (SELECT *, radians((hour(ts) * 60 + minute(ts) + second(ts) / 60.0 + 4.0 * lon + eot) / 4.0 - 180.0) AS h, sin(radians(lat)) AS sl, cos(radians(lat)) AS cl FROM sun_d),
sun_z AS (SELECT *, degrees(acos(least(greatest(sl * sin(dec) + cl * cos(dec) * cos(h), -1), 1))) AS zenith_deg,
  fmod(fmod(180.0 + degrees(atan2(sin(h), cos(h) * sl - tan(dec) * cl)), 360.0) + 360.0, 360.0) AS azimuth_deg FROM sun_h),
sun AS (SELECT *, CASE WHEN 90 - zenith_deg > -1 THEN (90 - zenith_deg) + (1 / 60.0::DOUBLE) / tan(radians((90 - zenith_deg) + 7.31 / ((90 - zenith_deg) + 4.4))) ELSE 90 - zenith_deg END AS apparent_elev_deg FROM sun_z)"""


SUN_SQL = f"{SITES_SQL},\n{sun_sql('sites')}"
_TILT = math.radians(solar.PLANE_TILT)
AOI_SQL = (f"degrees(acos(least(greatest(cos(radians(zenith_deg)) * {math.cos(_TILT)!r} + sin(radians(zenith_deg)) * {math.sin(_TILT)!r}"
           f" * cos(radians(azimuth_deg - {solar.PLANE_AZIMUTH})), -1), 1)))")
_IAM = f"CASE WHEN aoi_deg < 90 THEN greatest(1 - 0.05 * (1 / cos(radians(aoi_deg)) - 1), 0) ELSE 0 END"
# Numbers of the simplified Solis model at aerosol depth 0.1 and 1 cm of water, where ln(w) = 0.
CLEAR_SQL = f"""cs_p AS (SELECT *, ln(coalesce(pressure_hpa * 100, 100 * pow((44331.514 - alt) / 11880.516, {1 / 0.1902632!r})) / 101325) AS p FROM sun),
cs_t AS (SELECT *, 1364 * (0.12 * 0.01 + 0.97 * 0.1 + 1.08 + 0.071 * p) AS top, sin(radians(greatest(apparent_elev_deg, 1e-6))) AS s,
  0.182 + 0.33 + 0.1389 * p AS tb, 0.124 + 0.27 + 0.1079 * p AS tg,
  11.39 * 0.0001 - 20.43 * 0.001 + 15.366 * 0.01 - 5.6546 * 0.1 + 2.9457 - 0.71 * pow(1.1::DOUBLE, -15) * p AS td FROM cs_p),
cs AS (SELECT *, CASE WHEN apparent_elev_deg > 0 THEN top * exp(-tg / pow(s, {-0.3079 * 0.01 + 0.2846 * 0.1 + 0.3798!r})) * s ELSE 0 END AS clear_ghi,
  CASE WHEN apparent_elev_deg > 0 THEN top * exp(-tb / pow(s, {-0.7565 * 0.01 + 0.5057 * 0.1 + 0.4557!r})) ELSE 0 END AS clear_dni,
  CASE WHEN apparent_elev_deg > 0 THEN top * exp(-td / pow(s, -0.00337 + 0.063 + 0.116 + p / 33.2)) ELSE 0 END AS clear_dhi FROM cs_t)"""


def _sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solar.with_sun(sites(spark, sf_dir))


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sun(spark, sf_dir).withColumn("aoi_deg", solar.incidence_angle(F.col("zenith_deg"), F.col("azimuth_deg")))


@query("solar_position", f"WITH {SUN_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ts, {rounded('zenith_deg', 'azimuth_deg', 'apparent_elev_deg', digits=4)} FROM sun")
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_sun(spark, sf_dir).select(*ROW, "ts", "zenith_deg", "azimuth_deg", "apparent_elev_deg"), 4)


def _precise_sql() -> str:
    """The same terms, written out."""
    total = lambda terms: "((" + " + ".join(f"{a}::DOUBLE * cos({b} + {c} * t)" for a, b, c in terms) + ") * 1e-8)"
    l0, l1, l2 = (total(x) for x in solar.LONGITUDE_TERMS)
    angles = [f"radians({a} + ({b}) * t * 10)" for a, b in solar.NUTATION_ARGUMENTS]
    phase = lambda ns: " + ".join(f"{n} * {x}" for n, x in zip(ns, angles) if n)
    psi = " + ".join(f"({a}) * sin({phase(ns)})" for ns, a, _ in solar.NUTATION_TERMS)
    eps = " + ".join(f"({b}) * cos({phase(ns)})" for ns, _, b in solar.NUTATION_TERMS)
    return f"""WITH {SITES_SQL},
  d AS (SELECT l_orderkey, l_linenumber, ts, lat, lon, epoch_us(ts) / 86400e6 - 10957.5 AS d, (epoch_us(ts) / 86400e6 - 10957.5 + {solar.DELTA_T} / 86400) / 365250 AS t FROM sites),
  e AS (SELECT *, ({l2} * t + {l1}) * t + {l0} AS l, {total(solar.DISTANCE_TERMS)} AS r, ({psi}) / 3600 AS psi, ({eps}) / 3600 + 23.4392911 - 0.0130042 * t * 10 AS eps FROM d),
  f AS (SELECT *, degrees(l) + 180 + psi - 20.4898 / 3600 / r AS raw FROM e), g AS (SELECT *, raw - 360 * floor(raw / 360) AS lam FROM f),
  h AS (SELECT *, asin(sin(radians(eps)) * sin(radians(lam))) AS dec, radians(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t * 100 + psi * cos(radians(eps)) + lon
      - degrees(atan2(sin(radians(lam)) * cos(radians(eps)), cos(radians(lam))))) AS h FROM g),
  z AS (SELECT *, degrees(acos(greatest(least(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(h), 1), -1))) AS z,
      180 + degrees(atan2(sin(h), cos(h) * sin(radians(lat)) - tan(dec) * cos(radians(lat)))) AS a FROM h)
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ts, {R('lam', 4)} AS sun_longitude_deg, {R('degrees(dec)', 4)} AS declination_deg, {R('z + 8.794 / 3600 / r * sin(radians(z))', 4)} AS zenith_deg, {R('a - 360 * floor(a / 360)', 4)} AS azimuth_deg FROM z"""


@query("solar_position_precise", _precise_sql())
def solar_position_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = solar.with_precise_sun(sites(spark, sf_dir).select(*ROW, "ts", "lat", "lon"))
    return tidy(out.drop("lat", "lon"), 4)


@query("angle_of_incidence", f"WITH {SUN_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {R(AOI_SQL, 4)} AS aoi_deg FROM sun")
def angle_of_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_plane(spark, sf_dir).select(*ROW, "aoi_deg"), 4)


@query("clear_sky_irradiance", f"WITH {SUN_SQL}, {CLEAR_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {rounded('clear_ghi', 'clear_dni', 'clear_dhi', digits=3)} FROM cs")
def clear_sky_irradiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = solar.pressure_pa(F.col("pressure_hpa"), F.col("alt"))
    sky = solar.clear_sky(F.col("apparent_elev_deg"), F.col("p_pa"))
    return tidy(_sun(spark, sf_dir).withColumn("p_pa", p).withColumns(sky).select(*ROW, *sky), 3)


@query("solar_night", f"WITH {SUN_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (apparent_elev_deg <= 0)::BIGINT AS is_night FROM sun")
def solar_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_sun(spark, sf_dir).select(*ROW, solar.solar_night(F.col("apparent_elev_deg")).alias("is_night")))


@query("effective_irradiance", f"WITH {SUN_SQL}, a AS (SELECT *, {AOI_SQL} AS aoi_deg FROM sun) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {R(_IAM, 4)} AS iam, {R(f'direct * ({_IAM}) + diffuse', 3)} AS effective FROM a")
def effective_irradiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    aoi = F.col("aoi_deg")
    return tidy(_plane(spark, sf_dir).select(*ROW, solar.incidence_modifier(aoi).alias("iam"),
                                            solar.effective_irradiance(F.col("direct"), F.col("diffuse"), aoi).alias("effective")), 4, effective=3)


@query("cell_temperature", f"WITH {SITES_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {R('temp_c + direct / (25 + 6.84 * wind_ms)')} AS cell_c FROM sites")
def cell_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sites(spark, sf_dir).select(*ROW, solar.cell_temperature(F.col("temp_c"), F.col("direct"), F.col("wind_ms")).alias("cell_c")))


@query("poa_totals", f"WITH {SITES_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {R('diffuse + temp_c')} AS poa_diffuse, {R('direct + (diffuse + temp_c)')} AS poa_global FROM sites")
def poa_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sites(spark, sf_dir).select(*ROW, *[c.alias(n) for n, c in solar.poa_totals(F.col("direct"), F.col("diffuse"), F.col("temp_c")).items()]))


@query("system_losses", f"""WITH p AS (SELECT l_orderkey, l_discount + l_tax AS both_, CASE WHEN l_orderkey % 50 = 1 AND l_linenumber = 1 THEN 0 ELSE (1 - l_discount) * (1 - l_tax) END AS passed FROM lineitem)
  SELECT l_orderkey, {R('1 - product(passed)')} AS total_loss, {R('sum(both_) * 100')} AS sum_pct FROM p GROUP BY 1""")
def system_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Losses of a system come as rows: parts of an order, each with two losses; some parts pass nothing on.
    li = table(spark, sf_dir, "lineitem")
    dead = (F.col("l_orderkey") % 50 == 1) & (F.col("l_linenumber") == 1)
    passed = F.when(dead, 0.0).otherwise(1 - solar.combined_loss([F.col("l_discount"), F.col("l_tax")]))
    return tidy(li.groupBy("l_orderkey").agg(solar.total_loss(passed).alias("total_loss"), (F.sum(F.col("l_discount") + F.col("l_tax")) * 100).alias("sum_pct")))
