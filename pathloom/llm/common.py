"""What the operators share: reading tables, Arrow batches, and the cutting of lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans.lineage import cut

__all__ = ["batches", "cut", "give_back", "job", "table", "texts", "utf8"]

MOST_BYTES = 2 << 20
ARROW_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def job(spark: SparkSession) -> SparkSession:
    """The session of a job that runs these operators: Arrow batches of MOST_BYTES, unless the session names a size of its own.

    For the functions that are jobs (the registered queries, the pipeline's stages). Operators leave the session as it is; at
    Spark's default of 64 MB they need a few hundred MB more in each executor.
    """
    if spark.conf.get(ARROW_BYTES) == DEFAULT_BYTES:
        spark.conf.set(ARROW_BYTES, str(MOST_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, whatever else the table holds; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (n + 1) of a string or binary column without nulls, without a copy of the bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def batches(parts: Iterator[pa.RecordBatch], most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows, halved until they hold ``most`` bytes or a single row.

    What arrives is bounded by Spark (spark.sql.execution.arrow.maxBytesPerBatch); this bounds what an operator works on at once.
    """
    for part in parts:
        waiting = [part] if part.num_rows else []
        while waiting:
            piece = waiting.pop()
            if piece.num_rows == 1 or piece.nbytes <= most:
                yield piece
            else:
                half = piece.num_rows // 2
                waiting += [piece.slice(half), piece.slice(0, half)]


def give_back() -> None:
    """Hands memory that is free in this process back to the system: a Python worker keeps it from stage to stage otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
