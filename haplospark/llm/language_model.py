"""Bigram language model with deleted interpolation.

P(w | v) = a2 * c(v,w)/c(v) + a1 * c(w)/N + a0/(V+1). The weights depend on how
often the context v was seen (buckets by powers of two) and are learned by
expectation-maximisation on a part of the training documents, with counts from
which that part is deleted. All training documents then count for the scores.

Counts are exact and cover the corpus (see chunks.py). What reaches the driver
is a histogram of quantised probabilities, of bounded size, and the weights.

Defined cases: null and empty texts are the end token alone; repeated rows
count and are scored each; without training documents every count is 0 and the
score is the uniform share; without a deleted part the weights are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from haplospark.llm import kernels as K
from haplospark.llm.chunks import Chunk, chunk_of, chunked, count_everywhere, counts_in_order
from haplospark.llm.common import crc_bucket, give_back, table

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
TRAIN, DELETED, HELD = 0, 1, 2
BUCKETS = 16
#: Steps a factor of ten in the histogram for the weights, and the range in powers of ten.
STEPS, DEEPEST = 10, 12


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens with the ends, of what precedes each, and where documents begin."""
    now = np.insert(chunk.hashes, chunk.offsets[1:], END)
    offsets = chunk.offsets + np.arange(len(chunk.offsets))
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[offsets[:-1]] = START
    return now, before, offsets


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return K.mix(before * K.WORD_BASE + now)


def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs in one sorted array: the lowest bit tells which."""
    now, before, _ = tokens(chunk_of(row))
    one, pair = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFE)
    return np.unique(np.concatenate([now | one, pair_hash(before, now) & pair]), return_counts=True)


def looked_up(chunk: Chunk, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its count, its context's, the pair's; where documents begin; tokens' hashes."""
    now, before, offsets = tokens(chunk)
    one, pair = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFE)
    keys, which = np.unique(np.concatenate([now | one, pair_hash(before, now) & pair]), return_inverse=True)
    each = counts[which]
    c_now, c_pair = each[: len(now)], each[len(now) :]
    context = np.empty_like(c_now)
    context[1:] = c_now[:-1]
    ends = offsets[1:] - 1
    context[offsets[:-1]] = c_now[ends[0]] if len(ends) else 0  # as many starts as ends
    return c_now, context, c_pair, offsets, now


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def parts(c_now: np.ndarray, context: np.ndarray, c_pair: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    return c_pair / np.maximum(context, 1), c_now / max(n, 1), 1 / (v + 1)


def quantised(p: np.ndarray) -> np.ndarray:
    """0 for no probability."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint((np.log10(p) + DEEPEST) * STEPS) + 1, 1, DEEPEST * STEPS + 1), 0).astype(np.int64)


def learn_weights(histogram: np.ndarray, p0: float, rounds: int = 100) -> np.ndarray:
    """histogram: rows of bucket, quantised p2, quantised p1, count -> weights (BUCKETS, 3) for pair, word, uniform."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    value = lambda q: np.where(q > 0, 10.0 ** ((q - 1) / STEPS - DEEPEST), 0.0)
    for b in range(BUCKETS):
        h = histogram[histogram[:, 0] == b]
        if len(h):
            p, n = np.stack([value(h[:, 1]), value(h[:, 2]), np.full(len(h), p0)], 1), h[:, 3]
            for _ in range(rounds):
                share = p * weights[b]
                share /= share.sum(1, keepdims=True)
                weights[b] = (n[:, None] * share).sum(0) / n.sum()
            weights[b] = (weights[b] + 1e-6) / (weights[b] + 1e-6).sum()
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # a context never seen has no pairs
    return weights


def language_scores(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, role) with role TRAIN, DELETED (training too) or HELD -> doc_id, role, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = chunked(docs.withColumn("mark", F.lit(0).cast("long")), "lm-chunks").drop("marks")
    kind = chunks.schema["doc_ids"].dataType.elementType
    arrow_kind, kind = to_arrow_type(kind), kind.simpleString()
    counts, totals = count_everywhere(chunks, keys_of, ((TRAIN, DELETED), (TRAIN,)), "lm-counts")
    (_, _, v, n), (_, _, v0, n0) = totals  # words are the odd keys

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((0, 4), np.int64)
        for row in left.to_pylist():
            c_now, context, c_pair, _, _ = looked_up(chunk_of(row), counts_in_order(right, "counts_1"))
            p2, p1, _ = parts(c_now, context, c_pair, n0, v0)
            cells, times = np.unique(np.stack([bucket_of(context), quantised(p2), quantised(p1)], 1), axis=0, return_counts=True)
            out = np.concatenate([out, np.c_[cells, times]])
        return pa.table([pa.array(out[:, i], pa.int64()) for i in range(4)], names=["b", "q2", "q1", "n"])

    deleted = chunks.where(F.col("role") == DELETED)
    own = counts.join(deleted.select("chunk"), "chunk", "left_semi")
    cells = deleted.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(histogram, "b long, q2 long, q1 long, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))
    weights = learn_weights(np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, 4), 1 / (v0 + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            c_now, context, c_pair, offsets, _ = looked_up(chunk_of(row), counts_in_order(right, "counts_0"))
            p2, p1, p0 = parts(c_now, context, c_pair, n, v)
            w = weights[bucket_of(context)]
            logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((c_now + 1) / (n + v + 1))
            add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every document has a token
            rows.append((pa.array(row["doc_ids"], arrow_kind), row["role"], np.diff(offsets), add((c_now > 0).astype(np.int64)), add(base), add(logs)))
        give_back()
        size = [len(r[2]) for r in rows]
        return pa.table([pa.concat_arrays([r[0] for r in rows]), pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), size)), *[pa.array(np.concatenate([r[i] for r in rows])) for i in (2, 3)], pa.array(np.full(sum(size), n, np.int64)), *[pa.array(np.concatenate([r[i] for r in rows])) for i in (4, 5)]], names=["doc_id", "role", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    slim = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk"))
    return slim.applyInArrow(score, f"doc_id {kind}, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc_bucket("doc_id", 7)
    role = F.when(remainder == 2, HELD).when(remainder == 3, DELETED).otherwise(TRAIN).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", role.alias("role"))
    return language_scores(docs).select("doc_id", (F.col("role") == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
