"""Readers for the text and JSON forms that measurements arrive in."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.clean import coerce_double, drop_units_rows, euro_double
from ..functions.timecols import parse_ts
from ..operators.keys import match
from ..session import cut_lineage

# Time formats of the exports.
GERMAN_MINUTE = "dd.MM.yyyy HH:mm"
GERMAN_DAY = "dd.MM.yyyy"
ISO_MINUTE = "yyyy-MM-dd'T'HH:mm'+00:00'"


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_table(spark: SparkSession, path: str | list[str], names: Sequence[str], *, sep: str = ";",
                    provenance: bool = False) -> DataFrame:
    """A CSV export with all cells as text; the given schema avoids a pass to infer one."""
    reader = spark.read.schema(text_schema(names)).option("recursiveFileLookup", provenance)
    df = reader.csv(path, sep=sep, header=True, enforceSchema=True)
    return with_provenance(df) if provenance else df


def with_provenance(df: DataFrame) -> DataFrame:
    """Add the source that each row came from: ``source_path``, and its name.

    A source is a file; its name is the file's. Files that Spark has written into
    a folder ``column=value`` are parts of one source, the folder, named ``value``.
    """
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, "/[^/=]+=([^/]*)/[^/]*$", 1)
    parts = folder != ""
    return df.select("*", F.when(parts, F.regexp_replace(path, "/[^/]*$", "")).otherwise(path).alias("source_path"),
                     F.when(parts, F.url_decode(folder)).otherwise(F.url_decode(F.element_at(F.split(path, "/"), -1))).alias("source_file"))


# What names of time and energy columns hold.
TIME_NAME, TIME_TERMS = "Datum und Uhrzeit", ("datum", "date", "zeit", "time")
ENERGY_TERMS = ("Energie", "Energy", "Gesamtanlage", "PV Produktion", "Symo")


def _first_with(names: Column, pattern: str) -> Column:
    """Place (from 1) of the first name that matches; 0 where none does."""
    return F.array_position(F.transform(names, lambda n: n.rlike(pattern)), True)


def _any_of(terms: Sequence[str]) -> str:
    return "|".join(re.escape(t) for t in terms)


def read_exports(spark: SparkSession, path: str | list[str], *, sep: str = ";") -> DataFrame:
    """Files of mixed exports below ``path``: source_path, source_file, granularity,
    and the time and energy cells as text, units rows included.

    Each file is read by its own header: time is the column of that name or the
    first with a word for time, energy the first other column with a word for
    energy, or else the second column. A file has 5-minute steps if the first
    cell of its time column has a clock time, and days otherwise.

    Headers are an aggregate with one row per file; rows of any header are then
    read in one pass, their cells picked by the file's places, and written: what
    is derived from them, granularities first, does not read the files again.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    place = [F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at")]
    first = F.col("_metadata.file_block_start") == 0
    heads = lines.where(first).select(*place, "value").groupBy("_path").agg(F.min_by("value", "_at").alias("_head"))
    names = F.transform(F.split("_head", re.escape(sep), -1), lambda c: F.regexp_replace(c, '^[\\s"\ufeff]+|[\\s"]+$', ""))
    time = F.coalesce(F.nullif(F.array_position("_names", TIME_NAME), F.lit(0)), F.nullif(_first_with(F.col("_names"), f"(?i){_any_of(TIME_TERMS)}"), F.lit(0)))
    others = F.transform("_names", lambda n, i: F.when(i + 1 == F.col("_time"), "").otherwise(n))
    energy = F.coalesce(F.nullif(_first_with(others, _any_of(ENERGY_TERMS)), F.lit(0)), F.lit(2))
    heads = heads.select("_path", names.alias("_names")).withColumn("_time", time).withColumn("_energy", energy)
    heads = cut_lineage(heads.select("_path", F.size("_names").alias("_n"), F.col("_time").cast("int"), F.col("_energy").cast("int")))
    most = heads.agg(F.max("_n")).first()[0] or 1
    cells = [f"_c{i}" for i in range(max(most, 2))]
    raw = spark.read.schema(text_schema(cells)).option("recursiveFileLookup", True).csv(path, sep=sep, header=True, enforceSchema=True)
    raw = with_provenance(raw).select("source_path", "source_file", *place, first.alias("_first"), F.array(*cells).alias("_cells"))
    rows = match(raw, heads, "_path").where("_time is not null")  # a file without a time column has no readings
    rows = rows.select("source_path", "source_file", "_path", "_at", "_first", F.try_element_at("_cells", "_time").alias("time"), F.try_element_at("_cells", "_energy").alias("energy"))
    rows = cut_lineage(rows)
    clock = F.min_by("time", "_at").contains(":")
    flags = rows.where("_first").groupBy("_path").agg(F.when(clock, "5min").otherwise("daily").alias("granularity"))
    return match(rows, cut_lineage(flags), "_path", "left").select("source_path", "source_file", F.coalesce("granularity", F.lit("daily")).alias("granularity"), "time", "energy")


def parse_european(df: DataFrame, *, time: str, values: dict[str, str], ts: str = "ts", fmt: str = GERMAN_MINUTE) -> DataFrame:
    """Time and decimal-comma columns of an export; its units row is dropped."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != time and c not in values]
    return drop_units_rows(df, time).select(
        *rest, parse_ts(F.trim(F.col(f"`{time}`")), fmt).alias(ts),
        *[euro_double(F.col(f"`{old}`")).alias(new) for old, new in values.items()])


def parse_iso(df: DataFrame, *, time: str, values: Sequence[str], ts: str = "ts") -> DataFrame:
    """ISO minute times and plain numbers; rows whose time cannot be read are dropped."""
    rest = [F.col(c) for c in df.columns if c != time and c not in values]
    parsed = df.select(*rest, parse_ts(F.trim(F.col(time)), ISO_MINUTE).alias(ts), *[coerce_double(F.trim(F.col(v))).alias(v) for v in values])
    return parsed.where(F.col(ts).isNotNull())


def merge_exports(exports: DataFrame) -> DataFrame:
    """Daily energy from exports (``read_exports``) of both granularities: daily
    rows as they are, and 5-minute rows summed to days in kWh.

    A daily row whose time cannot be read keeps its energy, without a day.
    """
    body = drop_units_rows(exports, "time")
    value = euro_double(F.col("energy"))
    daily = body.where("granularity = 'daily'").select(
        F.to_date(parse_ts(F.trim("time"), GERMAN_DAY)).alias("day"), value.alias("energy_kwh"), "source_file", F.lit("daily").alias("data_type"))
    fine = body.where("granularity = '5min'").select(F.to_date(parse_ts(F.trim("time"), GERMAN_MINUTE)).alias("day"), value.alias("_wh"), "source_path", "source_file")
    summed = fine.where(F.col("day").isNotNull()).groupBy("day", "source_path", "source_file").agg((F.sum("_wh") / 1000.0).alias("energy_kwh"))
    return daily.unionByName(summed.select("day", "energy_kwh", "source_file", F.lit("5min_aggregated").alias("data_type")))


def forecast_schema(params: Sequence[str]) -> T.StructType:
    """The nested forecast document, with the given parameters."""
    series = T.StructType([T.StructField("data", T.ArrayType(T.DoubleType()))])
    properties = T.StructType([T.StructField("parameters", T.StructType([T.StructField(p, series) for p in params]))])
    feature = T.StructType([T.StructField("properties", properties)])
    return T.StructType([T.StructField("timestamps", T.ArrayType(T.StringType())), T.StructField("features", T.ArrayType(feature))])


def forecast_rows(df: DataFrame, *, document: Column, params: Sequence[str], keep: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Parallel arrays of forecast documents to one row per time."""
    parsed = df.select(*keep, F.from_json(document, forecast_schema(params)).alias("_d"))
    values = F.col("_d.features")[0]["properties"]["parameters"]
    zipped = F.arrays_zip(F.col("_d.timestamps").alias("_time"), *[values[p]["data"].alias(p) for p in params])
    rows = parsed.select(*keep, F.inline(zipped))
    return rows.toDF(*keep, "_time", *params).select(*keep, parse_ts(F.col("_time"), ISO_MINUTE).alias(ts), *params)
