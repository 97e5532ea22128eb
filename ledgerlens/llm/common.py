"""Helpers of the corpus operators: words, Arrow batches, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (a single machine, as in tests) gets a temporary folder; a cluster is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerlens-checkpoint-"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Compute once, as a Parquet table in the shared folder; its columns can be read one by one."""
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table of ``write_table`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only if a (kept) table of a few narrow columns has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of Arrow batches that gives freed memory back to the system when its task ends.

    Spark reuses Python workers, and idle ones keep what their allocators hold.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in glibc only
            if trim:
                trim(0)

    return wrapped


def lowered(text: str | bytes | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased and nothing else; null is empty."""
    if text is None:
        return b""
    return (text.encode() if isinstance(text, str) else text).translate(LOWER)


def text_arrays(column: pa.Array) -> pa.Array:
    """A string column without nulls (null is empty) with 32-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; every row is in one range, at least one row a range."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


def utf8(column: pa.Array, start: int, end: int) -> tuple[bytes, np.ndarray]:
    """The joined bytes of rows [start, end) and their byte offsets, from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset + start : column.offset + end + 1].astype(np.int64)
    data = column.buffers()[2]
    joined = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""
    return joined, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def other_columns(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of a frame that a result of these names doesn't replace."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
