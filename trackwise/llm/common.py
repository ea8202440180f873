"""What the operators share: reading tables, folds, shared scratch folders.

Row identity: ``doc_id`` is the callers' key but may be null or repeated, so an
operator that joins back to its rows does so on ``rid``, a row number that is
fixed once it has been written to the shared folder.
"""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.session import checkpoint_dir

#: White space as the contracts state it.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query that runs in here at the query's end, not at some later collection on
    the driver. For steps that are stored: nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once all that read it is stored itself."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(df: DataFrame, rows_each: int, least: int | None = None) -> int:
    """A partition count that grows with the rows of a stored frame."""
    n = df.count()
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n // rows_each))


def release() -> None:
    """Give the memory that this process no longer uses back to the machine: Arrow's pool and the allocator keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run, forget: Callable[[], None] | None = None) -> Run:
    """``run`` for ``mapInArrow``, in a worker that is used again by later tasks: at the end of the task ``forget``
    empties what the process holds for it, and unused memory goes back."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            release()

    return inner


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_trackwise_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    if root.is_dir():  # else the package came from such an archive itself
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/trackwise", "zip", root, "trackwise"))
    sc._trackwise_shipped = True
