"""Shared folder, table cuts and Arrow text access that several text operators use."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch, and bytes beyond which it takes no further row.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20
#: Bytes of text that one vectorised step works on; its work arrays take about 60 times that.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    A setting without a scheme is on Hadoop's default file system, for Spark's writers and for files that tasks
    write themselves alike. Where the setting is missing (a local session), a temporary folder is set in its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:" + tempfile.mkdtemp(prefix="pulsewarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python steps that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it of a URI as shared_folder gives it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Yield (first row, end row, bytes, offsets) of runs of whole rows of about limit bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def gathered(batches, limit: int, column: int = 0):
    """Arrow batches put together until one column has about limit bytes; a larger batch stands alone."""
    held, size = [], 0
    for batch in batches:
        more = batch.column(column).nbytes
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
