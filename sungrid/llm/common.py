"""What several operators share: reading tables, words of a text, splits by doc_id.

Texts reach Python as UTF-8 bytes. ASCII rules then hold as the contracts state
them: ``bytes.lower`` changes A-Z alone, ``bytes.split`` splits at 0x20 and
0x09-0x0D alone, and every byte from 0x80 up belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Lower-cases A-Z and turns every other ASCII byte but 0-9 and a-z into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return text.lower().split() if text else []


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % n


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches, each of about ``most`` bytes or a single row, so that
    what a task makes of a batch stays small however long its texts are."""
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, most // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())
