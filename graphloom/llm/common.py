"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of the input has, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (id, text), so that further columns of the input can have any names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column with null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def tidy() -> None:
    """Give freed memory back to the system: a worker that is used again would keep it, beside all that the JVM holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; what an earlier task of the worker has freed goes before them, what they took after them."""
    tidy()
    yield from (b for b in batches if b.num_rows)
    tidy()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift, odd multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two sequences one after the other, from their hashes; not symmetric."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x2545F4914F6CDD1D)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, by doubling; the last step overlaps if n is no power of two."""
    size, out = 1, h
    while size < n and len(out):
        step = min(size, n - size)
        out = join_hash(out[: max(0, len(out) - step)], out[step:])
        size += step
    return out


def sliding(op, x: np.ndarray, n: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each n consecutive values, by doubling."""
    size = 1
    while size < n and len(x):
        step = min(size, n - size)
        x = op(x[: max(0, len(x) - step)], x[step:])
        size += step
    return x


def map_rows(df: DataFrame, run, added: list[T.StructField] = ()) -> DataFrame:
    """mapInArrow over whole rows whatever their names: run sees columns c0, c1, ... in order."""
    inner = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    schema = T.StructType([*inner.schema.fields, *added])
    return inner.mapInArrow(run, schema).toDF(*df.columns, *(f.name for f in added))
