"""Session helpers: settings this library relies on, and where it may write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "sungrid") -> SparkSession:
    """A session for tests and local benches; on a cluster use its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All stored timestamps are zone-less UTC, so the session zone must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local_base: list[str] = []
_scratch: list[list[str]] = []


def _base(spark: SparkSession) -> str:
    """The shared folder. The cluster names it in ``spark.checkpoint.dir``; only a
    session on one machine (local, as in tests) may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="sungrid-"))
        base = _local_base[0]
    return base


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach."""
    path = f"{_base(spark).rstrip('/')}/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables that are written inside, and removes them at the
    end. Results are lazy: write or collect them inside."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read and not a recomputation, and a table
    that several steps read is made once. Spark also learns the true size: a
    table of parameters per series joins by broadcast when its files are below
    the session's threshold, without a shuffle of the data it joins, and by a
    sort-merge join with skew handling when they are not.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
