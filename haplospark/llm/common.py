"""Session settings, staging in the shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a folder of this machine is set, but only for a session that runs on this machine alone (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="haplospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/haplospark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts
    the lineage, and the files outlive any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files that ``staged`` wrote for ``df``, once nothing reads them."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that Spark hands to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Spark counts rows alone by default, and a batch of long texts would outgrow a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Memory that a step has freed goes back to the system: Python workers outlive their stage, and beside each other each
    would hold the most that it ever took. A C library without malloc_trim keeps it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer if need be, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows with about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(sizes.searchsorted(before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, text: str, schema: str, make: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, most):
                yield make(part)
                give_back()
        gc.collect()  # what a task made in cycles, as memories of words, must not wait for the next

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def some_rows(df: DataFrame, columns: list[str], rows: int, of: int) -> DataFrame:
    """Each row of ``df`` by its own chance, so that repeated and null values are spread: all, or at most ``rows`` of ``of`` (by four deviations)."""
    if of <= rows:
        return df
    hashed = df.withColumn("__salt", F.xxhash64(*columns, F.monotonically_increasing_id()))
    return hashed.where(F.pmod("__salt", F.lit(1 << 30)) < (rows - 4 * rows**0.5) / of * (1 << 30)).drop("__salt")
