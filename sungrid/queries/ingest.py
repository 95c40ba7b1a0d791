"""Sources and sinks: texts are written, read back, cleaned and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clean import energy_to_power, select_present
from ..operators.joins import union_all
from ..session import shared_dir
from ..sources import database, readers, sinks
from .base import E1H_SQL, EV_SQL, R, hourly, query, readings, table, tidy

EU_HEADER = ["Datum und Uhrzeit", "PV Produktion", "Nummer"]


def _with_units_rows(rows: DataFrame, group: str, units: list[str]) -> DataFrame:
    """One units row per source, as exports carry below their header."""
    heads = rows.select(group).distinct()
    texts = [F.lit(u).alias(c) for c, u in zip([c for c in rows.columns if c != group], units)]
    return rows.unionByName(heads.select(group, *texts))


@query("csv_eu_clean", f"""WITH {EV_SQL} SELECT series_id, event_id, date_trunc('minute', ts) AS ts,
  CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS energy_wh FROM ev""")
def csv_eu_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    number = F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    text = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, " #WERT! ").otherwise(F.concat(F.lit(" "), number))
    rows = ev.select(F.col("series_id"), F.date_format("ts", "dd.MM.yyyy HH:mm").alias("time"), text.alias("energy"),
                     F.col("event_id").cast("string").alias("number"))
    path = shared_dir(spark)
    _with_units_rows(rows, "series_id", ["[dd.MM.yyyy HH:mm]", "[Wh]", "[1]"]).write.partitionBy("series_id").csv(path, sep=";", header=True)
    raw = readers.read_text_table(spark, path, EU_HEADER)
    clean = readers.parse_european(raw, time=EU_HEADER[0], values={EU_HEADER[1]: "energy_wh"})
    return tidy(clean.select("series_id", F.col("Nummer").cast("long").alias("event_id"), "ts", "energy_wh"), 6)


@query("csv_iso_parse", f"""WITH {EV_SQL} SELECT event_id, date_trunc('minute', ts) AS ts, value FROM ev WHERE event_id % 9 <> 0""")
def csv_iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = readings(spark, sf_dir)
    time = F.when(F.col("event_id") % 9 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm'+00:00'"))
    path = shared_dir(spark)
    ev.select(time.alias("time"), F.col("event_id").cast("string"), F.col("value").cast("string")).write.csv(path, header=True)
    raw = readers.read_text_table(spark, path, ["time", "event_id", "value"], sep=",")
    clean = readers.parse_iso(raw, time="time", values=["value"])
    return tidy(clean.select(F.col("event_id").cast("long").alias("event_id"), "ts", "value"))


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of both granularities in one folder per source, read back as text."""
    fine = table(spark, sf_dir, "events").select(
        F.concat(F.lit("fine_"), "event_type").alias("source_file"), F.date_format("ts", "dd.MM.yyyy HH:mm").alias("Datum und Uhrzeit"),
        F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("Energie"))
    coarse = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("daily_"), F.substring("o_orderpriority", 1, 1)).alias("source_file"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("Datum und Uhrzeit"),
        F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("Energie"))
    path = shared_dir(spark)
    for rows, units in ((fine, ["[dd.MM.yyyy HH:mm]", "[Wh]"]), (coarse, ["[dd.MM.yyyy]", "[kWh]"])):
        _with_units_rows(rows, "source_file", units).write.mode("append").partitionBy("source_file").csv(path, sep=";", header=True)
    return readers.read_exports(spark, path)


@query("sniff_granularity", """SELECT source_file, granularity, count(*) + 1 AS n_rows FROM (
  SELECT 'fine_' || event_type AS source_file, '5min' AS granularity FROM events UNION ALL
  SELECT 'daily_' || substr(o_orderpriority, 1, 1), 'daily' FROM orders) GROUP BY 1, 2""")
def sniff_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exports(spark, sf_dir).groupBy("source_file", "granularity").agg(F.count(F.lit(1)).alias("n_rows"))


@query("ingest_with_provenance", f"""SELECT ts::DATE AS day, {R('sum(value) / 1000')} AS energy_kwh, 'fine_' || event_type AS source_file,
  '5min_aggregated' AS data_type FROM events GROUP BY 1, 3 UNION ALL
  SELECT o_orderdate::DATE, {R('o_totalprice')}, 'daily_' || substr(o_orderpriority, 1, 1), 'daily' FROM orders""")
def ingest_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(readers.merge_exports(_exports(spark, sf_dir)))


@query("ingest_flat_folder", f"""WITH f AS (
  SELECT ts::DATE AS day, '5min_aggregated' AS data_type, value / 1000 AS e FROM events UNION ALL
  SELECT CASE WHEN o_orderkey % 1000 <> 500 OR o_orderkey % 2 = 1 THEN o_orderdate::DATE END, 'daily', CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END FROM orders)
  SELECT day, data_type, {R('sum(e)', 4)} AS energy_kwh, CASE WHEN data_type = 'daily' THEN count(*) ELSE 1 END AS n_rows FROM f GROUP BY 1, 2""")
def ingest_flat_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One folder with 5-minute files, daily files with their columns in another
    # order, and daily files with some clock times; some numbers are the text NaN.
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    head, unit = "Datum und Uhrzeit", F.lit("[dd.MM.yyyy]")
    ev, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, "NaN").otherwise(comma(F.col("o_totalprice").cast("decimal(18,2)")))
    day, odd = F.date_format("o_orderdate", "dd.MM.yyyy"), F.col("o_orderkey") % 2 == 1
    stray = F.col("o_orderkey") % 1000 == 500
    time = F.when(stray, F.concat(day, F.lit(" 00:00"))).otherwise(day)
    number = F.col("o_orderkey").cast("string").alias("Nummer")
    path = shared_dir(spark)
    ev.select(F.date_format("ts", "dd.MM.yyyy HH:mm").alias(head), comma(F.col("value")).alias("PV Produktion")).write.csv(path, sep=";", header=True)
    orders.where(odd).select(number, price.alias("Energie"), day.alias("Datum")).write.mode("append").csv(path, sep=";", header=True)
    plain = orders.where(~odd).sortWithinPartitions(stray).select(time.alias(head), number, price.alias("Symo (2)"))
    plain.write.mode("append").csv(path, sep=";", header=True)
    units = spark.range(0, 1).select(unit.alias(head), F.lit("[1]").alias("Nummer"), F.lit("[kWh]").alias("Symo (2)"))
    units.write.mode("append").csv(path, sep=";", header=True)
    merged = readers.merge_exports(readers.read_exports(spark, path))
    n = F.when(F.col("data_type") == "daily", F.count(F.lit(1))).otherwise(F.lit(1).cast("long"))
    return tidy(merged.groupBy("day", "data_type").agg(F.sum("energy_kwh").alias("energy_kwh"), n.alias("n_rows")), 4)


@query("yearly_merge", f"""SELECT o_orderkey, year(o_orderdate) AS year, {R('o_totalprice * 12', 2)} AS power_w FROM orders""")
def yearly_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.year("o_orderdate").alias("year"), energy_to_power(F.col("o_totalprice")).alias("power_w"))
    path = shared_dir(spark)
    sinks.write_by_year(rows, path)
    merged = spark.read.parquet(path)
    return tidy(merged.select("o_orderkey", "year", "power_w"), 2)


@query("json_arrays_to_rows", f"""WITH {E1H_SQL} SELECT series_id, ts, {R('v_sum')} AS grad, {R('v_max')} AS t2m FROM e1h""")
def json_arrays_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One forecast document per series and day; a day has 24 hourly steps.
    hours = hourly(spark, sf_dir)
    steps = F.sort_array(F.collect_list(F.struct("ts", "v_sum", "v_max")))
    days = hours.groupBy("series_id", F.to_date("ts").alias("day")).agg(steps.alias("s"))
    pick = lambda c: F.struct(F.transform("s", lambda r: r[c]).alias("data"))
    times = F.transform("s", lambda r: F.date_format(r["ts"], "yyyy-MM-dd'T'HH:mm'+00:00'"))
    parameters = F.struct(pick("v_sum").alias("grad"), pick("v_max").alias("t2m"))
    feature = F.struct(F.struct(parameters.alias("parameters")).alias("properties"))
    docs = days.select("series_id", F.to_json(F.struct(times.alias("timestamps"), F.array(feature).alias("features"))).alias("doc"))
    return tidy(readers.forecast_rows(docs, document=F.col("doc"), params=["grad", "t2m"], keep=["series_id"]))


@query("json_props", """SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query("sql_parametrised", f"""SELECT event_type, count(*) AS n, {R('avg(value)')} AS mean_value FROM events
  WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' AND value > 10.5 GROUP BY 1""")
def sql_parametrised(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    out = database.run_query(
        spark, """SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM events
        WHERE ts >= cast(:low AS timestamp_ntz) AND ts < cast(:high AS timestamp_ntz) AND value > :floor GROUP BY 1""",
        {"low": "2024-01-08 00:00:00", "high": "2024-01-22 00:00:00", "floor": 10.5})
    return tidy(out)


_DESCRIBED = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
}


@query("catalog_describe", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS n_known FROM {t}"
    for t, cols in _DESCRIBED.items() for c, kind in cols))
def catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in _DESCRIBED:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    parts = []
    for name in [t for t in database.list_tables(spark) if t in _DESCRIBED]:
        df = spark.table(name)
        cols = database.describe_table(spark, name)
        counts = df.agg(*[F.count(c).alias(c) for c, _ in cols])
        cells = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.col(c).alias("n_known")) for c, kind in cols]
        parts.append(counts.select(F.inline(F.array(*cells))))
    return union_all(parts)


@query("parquet_roundtrip", f"""WITH {E1H_SQL} SELECT series_id, strftime(ts, '%Y-%m') AS month, ts, {R('v_mean')} AS v_mean, {R('v_sum')} AS v_sum FROM e1h""")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    sinks.write_series(hourly(spark, sf_dir).select("series_id", "ts", "v_mean", "v_sum"), path, key=["series_id"], ts="ts")
    return tidy(spark.read.parquet(path).select("series_id", F.col("month").cast("string"), "ts", "v_mean", "v_sum"))


@query("export_strings", f"""WITH {EV_SQL} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  replace(value::DECIMAL(18,2)::VARCHAR, '.', ',') AS value FROM ev""")
def export_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    rows = readings(spark, sf_dir).select("event_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    sinks.write_csv(rows, path, ts=["ts"], decimal_comma=["value"], sep=";")
    return spark.read.schema("event_id bigint, ts string, value string").csv(path, header=True, sep=";")


@query("export_json", f"""WITH {EV_SQL} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {R('value')} AS value FROM ev""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    sinks.write_json(readings(spark, sf_dir).select("event_id", "ts", "value"), path, ts=["ts"])
    return tidy(spark.read.schema("event_id bigint, ts string, value double").json(path))


@query("select_rename_present", """SELECT event_id, ts AS "time", value AS ghi_wm2 FROM events""")
def select_rename_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = {"ts": "time", "value": "ghi_wm2", "pressure": "pressure_hpa"}  # the last is not in the table
    return select_present(table(spark, sf_dir, "events"), renames, keep=["event_id"])
