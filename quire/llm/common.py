"""Shared pieces of the training-data operators: words, folds, shared tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_path, shared_table  # noqa: F401  (for the operators)

# Fixed value: what separates words (ASCII white space).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, through Spark's reader only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased (``bytes.lower`` and
    ``bytes.split`` know ASCII only, which is exactly the rule)."""
    return text.lower().split() if text else []


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Fold test on crc32 of the id's text; a null id is never held out."""
    fold = F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(fold == F.lit(remainder), F.lit(False))


def hash_fraction(*cols: Column, salt: str = "") -> Column:
    """A number in [0, 1) that depends only on the values (reruns agree)."""
    h = F.xxhash64(F.lit(salt), *cols)
    return F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))


def bounded_sample(df: DataFrame, key: Column, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all when there are fewer), chosen by a
    hash of ``key``.  Used only to fit models."""
    n = df.count()
    return df if n <= rows else df.where(hash_fraction(key, salt=salt) < F.lit(rows / n))


def batch_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a small slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples packed into Arrow batches of at most ``size`` rows."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _pack(buffer, schema)
            buffer = []
    if buffer:
        yield _pack(buffer, schema)


def _pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
