"""Tables that cut lineage, in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's own checkpoint folder; where none is set, a temporary one on a local
    master (as in tests), and an error on a cluster, whose machines share no such folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, and read again: computed once, and safe
    from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if path.rsplit("/", 1)[0].rstrip("/").endswith(shared_folder(table.sparkSession).rsplit("/", 1)[1]):
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def released(spark: SparkSession) -> None:
    """Lets Spark clear the shuffle files of tables that are no longer in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands Python at most BATCH_BYTES at a time (one row at least),
    so that a batch of long texts does not take the memory of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = df.sparkSession.conf.get(key, None)
    if have is None or not have.rstrip("b").isdigit() or not 0 < int(have.rstrip("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def _allocator():
    """The C library's allocator, where it can be told how to keep memory."""
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") and hasattr(library, "mallopt") else None


#: Arrays from this size on are mapped by themselves and go back to the system when freed.
MAPPED_BYTES = 4 << 20


def tidy(function):
    """A function over batches whose worker hands memory back to the system that it has freed,
    large arrays at once and the rest at its end: workers are used again and would otherwise
    hold their largest size."""

    @functools.wraps(function)
    def run(batches):
        library = _allocator()
        if library is not None:
            library.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD: fixed from now on
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if library is not None:
                library.malloc_trim(0)

    return run
