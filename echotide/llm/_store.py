"""Where intermediate tables go: the folder all executors and the driver share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written by this process that are still there.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local one for a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = f"file://{tempfile.mkdtemp(prefix='echotide-')}"
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def files_of(root: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(held, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
        WRITTEN[:] = [p for p in WRITTEN if p.split(":", 1)[-1].lstrip("/") != path.split(":", 1)[-1].lstrip("/")]


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside; one that is to outlast it gets its path before."""
    before = set(WRITTEN)
    yield
    for path in [p for p in WRITTEN if p not in before]:
        _delete(spark, path)
        WRITTEN.remove(path)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Hold Arrow batches to a few megabytes, so that long texts fit a Python worker.

    The setting stays with the session, as it must still hold when the caller runs the lazy result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def portions(batch: pa.RecordBatch, column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in slices that end with the row that fills ``size`` bytes of the string column."""
    begin = held = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 1):
        held += n
        if held >= size:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
    if begin < batch.num_rows or not batch.num_rows:
        yield batch.slice(begin)


def give_back() -> None:
    """Freed memory goes back to the system: what an allocator keeps counts for the executor, whoever runs next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Run) -> Run:
    """``run`` for ``mapInArrow``; workers outlive tasks and stages, so each task ends by giving its memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
