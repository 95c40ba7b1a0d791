"""Chronological, expanding-window and random splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import DAY, row_index


def chrono_split(df: DataFrame, *, key: Sequence[str], ts: str, train: float = 0.7, val: float = 0.15,
                 block_s: int = DAY) -> DataFrame:
    """Add ``rn``, ``n`` and ``split``: train and val sizes are rounded down, and
    test takes the rest."""
    out = row_index(df, key=key, ts=ts, block_s=block_s, total="n")
    n_train = F.floor(F.col("n") * F.lit(train))
    n_val = F.floor(F.col("n") * F.lit(val))
    split = F.when(F.col("rn") < n_train, "train").when(F.col("rn") < n_train + n_val, "val").otherwise("test")
    return out.withColumn("split", split)


def holdout_split(df: DataFrame, *, key: Sequence[str], ts: str, test: float = 0.15, block_s: int = DAY) -> DataFrame:
    """The last part of each series is the final test; its size is rounded down."""
    out = row_index(df, key=key, ts=ts, block_s=block_s, total="n")
    n_test = F.floor(F.col("n") * F.lit(test))
    return out.withColumn("split", F.when(F.col("rn") < F.col("n") - n_test, "train").otherwise("test"))


def expanding_folds(df: DataFrame, *, key: Sequence[str], ts: str, k: int = 5, block_s: int = DAY) -> DataFrame:
    """One row per fold and role a row has; each fold trains on all earlier rows."""
    out = row_index(df, key=key, ts=ts, block_s=block_s, total="n")
    size = F.floor(F.col("n") / F.lit(k + 1))
    roles = []
    for fold in range(k):
        start = F.col("n") - (k - fold) * size
        role = F.when(F.col("rn") < start, "train").when(F.col("rn") < start + size, "val")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(fold).cast("long").alias("fold"), role.alias("role"))))
    return out.select("*", F.inline(F.array_compact(F.array(*roles))))


_HASHES = 1 << 60


def row_hash(key: Sequence[str], seed: int) -> Column:
    """60 bits of the MD5 of the key's texts and a seed, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def random_split(df: DataFrame, *, key: Sequence[str], test_pct: int = 20, seed: int = 42) -> DataFrame:
    """A split by the hash of the row key: the same on every run and machine."""
    return df.withColumn("split", F.when(row_hash(key, seed) % 100 < test_pct, "test").otherwise("train"))


def sample_rows(df: DataFrame, *, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest key hashes: a repeatable random sample.

    Hashes are uniform, so a threshold leaves little more than ``n`` rows to sort,
    however many partitions there are. Should it leave fewer, all rows are sorted.
    """
    hashed = df.withColumn("_hash", row_hash(key, seed))
    few = df.count()
    share = (n + 10 * n**0.5 + 100) / max(few, 1)
    if share < 1:
        under = hashed.where(F.col("_hash") < int(share * _HASHES))
        hashed = under if under.count() >= n else hashed
    return hashed.orderBy("_hash", *key).limit(n).drop("_hash")
