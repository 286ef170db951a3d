"""Vectors as integer matrices in blocks: a Parquet row holds some thousand vectors as one buffer, so that a task works on matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import bound_batches

#: Vectors of a block; a block of 64 components is 1 MB.
BLOCK_ROWS = 4096
#: A component x becomes floor(SCALE * x); beyond this bound it counts as the bound, so that sums of 256 products of two fit in 63 bits.
SCALE, BOUND = 256, 1 << 26

BLOCK_SCHEMA = "ids array<bigint>, tags array<bigint>, vectors binary"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) within BOUND."""
    return np.clip(np.floor(flat * SCALE), -BOUND, BOUND).astype(np.int64)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list array as rows of ``width`` components; shorter lists end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def blocks(df: DataFrame, vec_id: Column, tag: Column, vector: Column, width: int) -> DataFrame:
    """BLOCK_SCHEMA rows of at most BLOCK_ROWS vectors of integers, four bytes a component; ids may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                whole = integers(matrix(part.column("vector"), width)).astype(np.int32)
                one = [pa.array([part.column(c)], pa.list_(pa.int64())) for c in ("id", "tag")]
                yield pa.RecordBatch.from_arrays([*one, pa.array([whole.tobytes()], pa.binary())], names=["ids", "tags", "vectors"])

    bound_batches(df.sparkSession)
    return df.select(vec_id.cast("long").alias("id"), tag.cast("long").alias("tag"), vector.cast("array<double>").alias("vector")).mapInArrow(run, BLOCK_SCHEMA)


def unpacked(buffer: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(buffer, np.int32).reshape(rows, -1).astype(np.int64)
