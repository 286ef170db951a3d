"""Texts as chunks of word numbers, and exact corpus-wide counts for the keys of each chunk.

A chunk is a few megabytes of text: its distinct words' hashes and, for each
word in order, that word's number. Chunks are written once and read by each
later step, so words are cut and hashed once.

``count_everywhere`` counts keys (n-grams, shingles) over all chunks. A chunk
sends each distinct key once, packed by ranges of the hash (shards): sorted
hashes are sent as differences, about 6 bytes each. A shard sums its keys and
sends counts back in the same order, so no key travels twice. A key that is
everywhere arrives once from each chunk, hence no shard is hot. An empty pair of
chunk and shard sends nothing: beyond some thousand chunks the rows sent are
bounded by the keys themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm import kernels as K
from haplospark.llm.common import bound_batches, give_back, staged, text_slices

#: Bytes of a chunk's text, about, and what a row counts beside its text, so that a chunk of short texts has an end too.
CHUNK_BYTES, ROW_BYTES = 4 << 20, 16
#: Keys that one shard takes, about.
SHARD_KEYS = 1 << 19


def pack(x: np.ndarray) -> bytes:
    """Bytes of each significance together, compressed: high bytes are mostly 0."""
    x = np.ascontiguousarray(x)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T[:width]
    raw = np.ascontiguousarray(planes).tobytes()
    return np.array([len(x), width, x.itemsize], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, width, size = (int(v) for v in np.frombuffer(b[:12], "<u4"))
    raw = pa.decompress(b[12:], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    out = np.zeros((n, size), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(f"<u{size}").ravel()


@dataclass
class Chunk:
    """words: hashes of the distinct words; stream: their numbers in order; offsets: where each document begins in it."""

    words: np.ndarray
    stream: np.ndarray
    offsets: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.words[self.stream]


def chunked(docs: DataFrame, name: str, describe: Callable[[Chunk], list[np.ndarray]] = lambda chunk: [], columns: tuple[str, ...] = (), most: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text, role int, mark long) -> written chunks: chunk, role, doc_ids, marks, counts, words, stream, and
    ``columns``, arrays with a long for each document as ``describe`` gives them. A chunk has one role and is filled with about
    ``most`` bytes from as many batches as that takes: fewer chunks repeat fewer keys. A-Z count as a-z.
    A chunk's number has 43 bits: 23 of the partition, 20 within it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def chunk(number: int, role: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        found = K.words_of(K.texts_of(rows.column("text"), lower=True))
        words, stream = np.unique(found.hashes, return_inverse=True)
        more = describe(Chunk(words, stream, found.offsets)) if columns else []
        row = [pa.array([number], pa.int64()), pa.array([role], pa.int32()), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("doc_id")), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("mark")), pa.array([found.counts], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()), pa.array([pack(stream.astype(np.uint32))], pa.binary())]
        return pa.RecordBatch.from_arrays([*row, *(pa.array([x], pa.list_(pa.int64())) for x in more)], names=["chunk", "role", "doc_ids", "marks", "counts", "words", "stream", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 20, defaultdict(list), defaultdict(int)
        for batch in batches:
            roles = batch.column("role").to_numpy(zero_copy_only=False)
            for role in np.unique(roles).tolist():
                for part in text_slices(batch.filter(pa.array(roles == role)), "text", most):
                    more = (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + ROW_BYTES * part.num_rows
                    if waiting[role] and size[role] + more > most:
                        yield chunk(number, role, waiting.pop(role))
                        number, size[role] = number + 1, 0
                        give_back()
                    waiting[role].append(part)
                    size[role] += more
        for role, parts in waiting.items():
            yield chunk(number, role, parts)
            number += 1
            give_back()

    return staged(docs.select("doc_id", "text", "role", "mark").mapInArrow(run, f"chunk long, role int, doc_ids array<{kind}>, marks array<long>, counts array<long>, words binary, stream binary" + "".join(f", {c} array<long>" for c in columns)), name)


def chunk_of(row: dict) -> Chunk:
    return Chunk(np.frombuffer(row["words"], np.uint64), unpack(row["stream"]), np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))]))


#: From a chunk's row: its sorted distinct keys, and how often each counts.
Keys = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def count_everywhere(chunks: DataFrame, keys_of: Keys, counted: tuple[tuple[int, ...], ...], name: str) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """counted: sets of roles. -> written rows (chunk, shard, counts_0, ...), where counts_i are over the
    chunks whose role is in counted[i], for the chunk's keys in order; and for each i the number of distinct keys
    and the sum of counts, of even keys and of odd ones."""
    total = chunks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b + 1))).first()[0] or 1
    bits = min(40, max(4, int(total / SHARD_KEYS).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, times = keys_of(row)
                shard = keys >> np.uint64(64 - bits)
                at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.zeros(0, np.int64)
                ends = np.r_[at[1:], len(keys)]
                out = [[int(shard[a]) for a in at], [pack(np.diff(keys[a:b], prepend=shard[a] << np.uint64(64 - bits))) for a, b in zip(at, ends)], [pack(times[a:b].astype(np.uint32)) for a, b in zip(at, ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["chunk"])), pa.array(np.full(len(at), row["role"], np.int32)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["chunk", "role", "shard", "keys", "times"])
                give_back()

    n = len(counted)
    results = ", ".join(f"counts_{i} binary" for i in range(n))

    def add(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        parts = [np.cumsum(unpack(k), dtype=np.uint64) for k in rows.column("keys").to_pylist()]
        base = np.uint64(shard) << np.uint64(64 - bits)
        sizes, roles = np.array([len(p) for p in parts]), np.repeat(rows.column("role").to_numpy(), [len(p) for p in parts])
        keys = np.concatenate(parts) + base
        times = np.concatenate([unpack(t) for t in rows.column("times").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
        out, summary, odd = [], [], ordered[first] & np.uint64(1) == 1
        ends = np.cumsum(sizes)
        for roles_counted in counted:
            sums = np.bincount(which, times * np.isin(roles, roles_counted), minlength=len(first)).astype(np.int64)
            each = sums[which].astype(np.uint64)
            out.append([pack(each[e - s : e]) for s, e in zip(sizes, ends)])
            summary.append(np.array([(sums > 0)[~odd].sum(), sums[~odd].sum(), (sums > 0)[odd].sum(), sums[odd].sum()], np.uint64).tobytes())
        chunk = rows.column("chunk").to_pylist()
        del keys, times, order, ordered, which, parts
        give_back()
        return pa.table([pa.array([*chunk, -1], pa.int64()), pa.array([shard] * (len(chunk) + 1), pa.int64()), *[pa.array([*o, s], pa.binary()) for o, s in zip(out, summary)]], names=["chunk", "shard", *(f"counts_{i}" for i in range(n))])

    sent = chunks.mapInArrow(send, "chunk long, role int, shard long, keys binary, times binary")
    back = staged(sent.groupBy("shard").applyInArrow(add, f"chunk long, shard long, {results}"), name)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(4 * n, np.int64)
        for batch in batches:
            for i in range(n):
                for b in batch.column(f"counts_{i}").to_pylist():
                    acc[4 * i : 4 * i + 4] += np.frombuffer(b, np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([a]) for a in acc], names=[f"v{i}" for i in range(4 * n)])

    row = back.where("chunk = -1").mapInArrow(sums, ", ".join(f"v{i} long" for i in range(4 * n))).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(4 * n)]).first()
    return back.where("chunk >= 0"), [tuple(row[4 * i + k] or 0 for k in range(4)) for i in range(n)]


def counts_in_order(rows: pa.Table, column: str) -> np.ndarray:
    """A chunk's counts from its rows of all shards, in the order of its keys."""
    rows = rows.sort_by("shard")
    return np.concatenate([unpack(b) for b in rows.column(column).to_pylist()]).astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
