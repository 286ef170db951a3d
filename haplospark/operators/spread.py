"""How rows are dealt to tasks before a step that holds a partition in memory, and small tables that go to all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a join broadcasts at most.
BROADCAST_ROWS = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many partitions as the session has for shuffles. Left alone, adaptive execution merges partitions up to a size on disk; narrow rows take
    some twenty times that in the sorts and joins of a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def if_small(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``rows``, broadcast if they, or the table ``of`` that bounds their number, are few; else joined by a shuffle. With few keys a shuffle by key puts all rows
    in as few tasks."""
    few = (rows if of is None else of).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(rows) if few else rows
