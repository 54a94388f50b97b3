"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Gives free memory of the C library back to the system, where it can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset on one machine (master local, as in tests) a temporary
    folder is made, and set, so that one session keeps to one folder; on a
    cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here.

    The copy outlives lost executors. It stays until the folder is cleaned.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo five, is zero. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def _text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of the strings and binaries of each row, those inside structs included."""
    if pa.types.is_struct(column.type):
        return sum((_text_bytes(pc.struct_field(column, i)) for i in range(column.type.num_fields)), np.zeros(len(column), np.int64))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.zeros(len(column), np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that few texts are Python strings at a time.

    A slice has at most `rows` rows and `size` bytes of text, or one row. What
    the task took goes back at the end, since Python workers live on.
    """
    for batch in batches:
        ends = np.cumsum(sum(map(_text_bytes, batch.columns), np.zeros(batch.num_rows, np.int64)))
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = max(at + 1, min(at + rows, full))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
    give_back()


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 500) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of at most `rows` rows.

    Spark's own 10,000 rows are too many where a row holds a whole text: both
    sides of the exchange keep a batch in memory. A size that the session
    states itself stays.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_ROWS, None) is None:
        spark.conf.set(_BATCH_ROWS, str(rows))
    return df.mapInArrow(run, schema)


def drawn(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """All rows if there are at most `rows`, else about so many, by hash of the key."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit("drawn")), F.lit(1 << 30)) < (1 << 30) * rows // n)
