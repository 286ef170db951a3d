"""Centroid clustering by the exponion search.

Each vector keeps an upper bound of its distance to its centroid and a lower
bound of that to all others. When centroids have moved, the bounds are widened
by how far they moved; a vector whose upper bound is below the lower one, or
below half the distance from its centroid to the next, stays. For the others
the upper bound is made exact, and if that isn't enough only the centroids in a
ball around their own are looked at: those of its list, sorted by distance, up
to twice the upper bound and the distance to its nearest centroid. The radius
is inclusive and bounds are widened by a part in a billion, so a centroid that
ties is never missed; squared distances are exact integers, and the smaller
number wins a tie.

Vectors stand in blocks of some thousand (``vectors``); a round is one pass
that writes the blocks with their new state and the sums of each cluster in
each block. Spark adds the sums; only the centroids, k rows, reach the driver.
The blocks of the round before are deleted.

Defined cases: null vectors, vectors of another length and those with a null or
non-finite component are left out; a null id is hashed as '' for the choice of
the first centroids, and equal hashes go by the vector; rows of equal id are
vectors of their own; with fewer than k vectors, each is a centroid; an empty
table gives no rows; other columns aren't read, whatever their names. Components
beyond 2^26 after scaling count as 2^26.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import bound_batches, drop_staged, staged, table
from haplospark.llm.vectors import blocks, integers, unpacked, usable

#: Bounds are widened by this share, far more than doubles lose.
MARGIN = 1e-9
STATE_SCHEMA = "ids array<bigint>, vectors binary, cluster binary, upper binary, lower binary, sums array<struct<cluster int, n bigint, inertia bigint, total array<bigint>>>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids of a round: how far they have moved and, for each, all others by distance."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        apart = np.sqrt(np.array([squared(at, c) for c in at], np.float64).reshape(len(at), len(at))) * (1 - MARGIN)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1) if len(at) else np.zeros(0)
        self.moved = np.zeros(len(at)) if before is None else np.sqrt(squared(at, before).astype(np.float64)) * (1 + MARGIN)
        others = np.sort(self.moved)[::-1][:2]
        self.others_moved = np.where(self.moved == others[0], others[-1] if len(others) > 1 and (self.moved == others[0]).sum() == 1 else others[0], others[0])


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> None:
    """One round for the vectors ``x``; the state is changed in place. Clusters with bounds of infinity and zero are not known yet."""
    upper += c.moved[cluster]
    lower -= c.others_moved[cluster]
    safe = np.maximum(c.nearest[cluster] / 2, lower) * (1 - MARGIN)
    open_ = np.flatnonzero(~(upper < safe))
    upper[open_] = np.sqrt(squared(x[open_], c.at[cluster[open_]]).astype(np.float64)) * (1 + MARGIN)
    open_ = open_[~(upper[open_] < safe[open_])]
    for own in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == own]
        inside = np.searchsorted(c.apart[own], (2 * upper[rows] + c.nearest[own]) * (1 + MARGIN), "right")
        most_first = np.argsort(-inside, kind="stable")
        rows, inside = rows[most_first], inside[most_first]
        least, second, who = (np.full(len(rows), v, np.int64) for v in (np.iinfo(np.int64).max, np.iinfo(np.int64).max, 0))
        for t in range(inside[0]):
            n, j = int(np.searchsorted(-inside, -t, "left")), c.order[own][t]
            d = squared(x[rows[:n]], c.at[j])
            better = (d < least[:n]) | ((d == least[:n]) & (j < who[:n]))
            second[:n] = np.where(better, least[:n], np.minimum(second[:n], d))
            least[:n] = np.where(better, d, least[:n])
            who[:n] = np.where(better, j, who[:n])
        cluster[rows] = who
        upper[rows] = np.sqrt(least.astype(np.float64)) * (1 + MARGIN)
        lower[rows] = np.sqrt(second.astype(np.float64)) * (1 - MARGIN)


def cluster_sums(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> list[dict]:
    order = np.argsort(cluster, kind="stable")
    names, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
    if not len(names):
        return []
    totals, inertia = np.add.reduceat(x[order], starts, axis=0), np.add.reduceat(distance[order], starts)
    return [{"cluster": int(k), "n": int(n), "inertia": int(i), "total": row} for k, n, i, row in zip(names, counts, inertia, totals.tolist())]


def _round(state: DataFrame, centroids: Centroids) -> DataFrame:
    """STATE_SCHEMA blocks after one round; blocks that have no state yet begin with one."""
    known, schema = "cluster" in state.columns, pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("vectors", "cluster", "upper", "lower"))])
    sums_type = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("total", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                x = unpacked(batch.column("vectors")[i].as_py(), len(ids))
                read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind).copy()  # noqa: B023, E731
                cluster, upper, lower = (read("cluster", np.int32), read("upper", np.float64), read("lower", np.float64)) if known else (np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x)))
                assign(x, cluster, upper, lower, centroids)
                sums = cluster_sums(x, cluster, squared(x, centroids.at[cluster]))
                one = [pa.array([v], f.type) for v, f in zip((ids, batch.column("vectors")[i].as_py(), cluster.tobytes(), upper.tobytes(), lower.tobytes()), schema)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([sums], sums_type)], names=[*schema.names, "sums"])

    bound_batches(state.sparkSession)
    return state.select("ids", "vectors", *(("cluster", "upper", "lower") if known else ())).mapInArrow(run, STATE_SCHEMA)


def moved_centroids(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' exact floor(sum / count) by component; a centroid without vectors stays. Sums are added in Spark, block by block."""
    each = state.select(F.explode("sums").alias("s")).select("s.cluster", "s.n", F.posexplode("s.total").alias("axis", "part"))
    wide = F.sum(F.col("part").cast("decimal(20,0)"))
    out = at.copy()
    for row in each.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), wide.alias("total")).collect():  # k x width rows
        out[row["cluster"], row["axis"]] = int(row["total"]) // row["n"]
    return out


def first_centroids(df: DataFrame, vec_id: str, vector: str, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted id has the least sha256, in that order."""
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))).cast("binary"), 256)
    found = df.select(hashed.alias("hash"), F.col(vector).cast("array<double>").alias("vector")).orderBy("hash", "vector").limit(k).collect()
    return np.array([integers(np.array(row["vector"], np.float64)) for row in found], np.int64)


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """-> (vec_id, cluster, distance) of every vector kept, and the centroids after ``rounds`` rounds and the last assignment."""
    spark = df.sparkSession
    kept = df.select(vec_id, vector).where(usable(F.col(vector)) & (F.size(vector) == width))
    at = first_centroids(kept, vec_id, vector, k, salt)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), at
    state, before = staged(blocks(kept, F.col(vec_id), F.lit(0), F.col(vector), width), "vectors"), None
    for i in range(rounds + 1):
        now = staged(_round(state, Centroids(at, before)), f"round-{i}")
        drop_staged(state)
        state = now
        if i < rounds:
            before, at = at, moved_centroids(state, at)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, cluster = batch.column("ids")[i].values, np.frombuffer(batch.column("cluster")[i].as_py(), np.int32)
                distance = squared(unpacked(batch.column("vectors")[i].as_py(), len(ids)), at[cluster])
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    own = state.select(F.explode("sums").alias("s")).groupBy("s.cluster").agg(F.sum("s.inertia").alias("cluster_inertia"))
    inertia = {row["cluster"]: row["cluster_inertia"] for row in own.collect()}  # k rows at most
    each = state.select("ids", "vectors", "cluster").mapInArrow(rows, "vec_id long, cluster int, distance long")
    of_cluster = reduce(lambda c, i: c.when(F.col("cluster") == i[0], F.lit(i[1])), inertia.items(), F.when(F.lit(False), F.lit(0)))
    return each.withColumns({"cluster_inertia": of_cluster.cast("long"), "inertia": F.lit(sum(inertia.values())).cast("long")}), at


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()] or [""]
    return found.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1))


_SQUARED = "(x.ee - 2 * list_inner_product(x.e, c.e) + list_inner_product(c.e, c.e))::BIGINT"
_ASSIGN = "n{i} AS MATERIALIZED (SELECT x.r, min(({squared}, c.j)) AS best FROM kept x, c{i} c GROUP BY x.r)"
_MOVE = """c{j} AS MATERIALIZED (
  SELECT c.j, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
    SELECT j, list(floor(total::DECIMAL(38,0)::DOUBLE / n) ORDER BY d) AS e FROM (
      SELECT n.best[2] AS j, d, sum(x.e[d]::BIGINT) AS total, count(*) AS n FROM n{i} n JOIN kept x USING (r), (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2) GROUP BY j) m ON m.j = c.j)"""
OP13_SQL = f"""WITH kept AS MATERIALIZED (
  SELECT *, list_inner_product(e, e) AS ee FROM (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS j, e FROM kept QUALIFY j < 40
), {", ".join(part for i in range(5) for part in (_ASSIGN.format(i=i, squared=_SQUARED), _MOVE.format(i=i, j=i + 1)))},
{_ASSIGN.format(i=5, squared=_SQUARED)}, last AS (SELECT x.vec_id, n.best[2] AS cluster, n.best[1] AS distance FROM n5 n JOIN kept x USING (r))
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c5.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM last JOIN c5 ON c5.j = cluster"""
