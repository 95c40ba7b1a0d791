"""Relational access: list and describe tables, run SQL with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    """Name and type of each column."""
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def run_query(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """SQL with named ``:parameters``; values never become part of the text."""
    return spark.sql(query, args=params or {})


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower: str = "", upper: str = "",
              partitions: int = 32, **options: str) -> DataFrame:
    """A database table; with a partition column, many tasks read ranges of it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=str(partitions))
    return reader.load()
