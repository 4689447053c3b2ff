"""Shared helpers: table loading, lineage cuts, Arrow batch access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.functions.tables import cut, shared_root

__all__ = ["column_buffers", "cut", "drop_cut", "slices", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    spark, root = df.sparkSession, shared_root(df.sparkSession)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def column_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; a null is an empty value."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    n = len(array)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=n + 1 + array.offset)[array.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer value is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
