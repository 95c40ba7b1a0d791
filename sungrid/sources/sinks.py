"""Writers: parquet by series and month, CSV and JSON records with text times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import comma_text

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"  # fixed value: time format of exports


def write_series(df: DataFrame, path: str, *, key: Sequence[str], ts: str, mode: str = "error") -> None:
    """Parquet by series and month. Rows meet by (series, month), and Spark cuts what
    is large into tasks, and joins what is small, by size."""
    out = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    out.hint("rebalance", *key, "month").write.mode(mode).option("compression", "snappy").partitionBy(*key, "month").parquet(path)


def write_by_year(df: DataFrame, path: str, *, year: str = "year", mode: str = "error") -> None:
    """One folder per year; a large year is cut into tasks by size."""
    df.hint("rebalance", year).write.mode(mode).option("compression", "snappy").partitionBy(year).parquet(path)


def text_records(df: DataFrame, *, ts: Sequence[str], decimal_comma: Sequence[str] = ()) -> DataFrame:
    """Times and decimal-comma numbers as the texts that exports carry."""
    times = {c: F.date_format(c, TIME_TEXT) for c in ts}
    numbers = {c: comma_text(F.col(c)) for c in decimal_comma}
    return df.withColumns({**times, **numbers})


def write_csv(df: DataFrame, path: str, *, ts: Sequence[str], decimal_comma: Sequence[str] = (), sep: str = ",", mode: str = "error") -> None:
    text_records(df, ts=ts, decimal_comma=decimal_comma).write.mode(mode).csv(path, header=True, sep=sep)


def write_json(df: DataFrame, path: str, *, ts: Sequence[str], mode: str = "error") -> None:
    text_records(df, ts=ts).write.mode(mode).json(path)
