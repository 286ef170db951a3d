"""Token-id files: Huffman-coded blocks with bit-offset checkpoints.

File format: a Parquet table with one row for each block, in ascending document
order: shard, block, first (ids of the shard before it), doc_ids, n_tokens of
each document, offsets (bit offset of every 128th id), payload (canonical
Huffman bits). A block holds whole documents, about 131,072 ids, and decodes
alone. ``codebook`` beside it holds the code length of each id; that is all a
canonical code needs.

One pass tokenizes and writes each document's ids, two bytes or four each;
global counts and the code come from these, and after a range shuffle by doc_id
they are encoded. Each distinct piece is tokenized once a task and looked up
after that: this tokenizer never joins characters over white space,
nor a letter with a sign other than an apostrophe, so a text's ids are its
pieces' ids end to end. It lowers case itself, so pieces are lowered first
unless its case-sensitive special tokens may occur.

Hot ids: rows with the same doc_id are spread by their text's hash and place.
Defined cases: null and empty texts give the end id alone; null doc_ids come
first; rows that repeat each get their own span, ordered by text; an empty
table gives an empty file.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from haplospark.llm import huffman as H
from haplospark.llm import kernels as K
from haplospark.llm.common import bound_batches, drop_staged, give_back, shared_dir, staged, table, text_slices

END_ID, BLOCK_IDS, SLICE, WORDS_KEPT, AT_ONCE = 1, 1 << 17, 512 << 10, 300_000, 1024
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN = np.zeros(256, bool)
SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = True
#: What this tokenizer's cut makes of lower-case ASCII and Latin letters without combining marks; PLAIN are texts of these alone.
_LATIN = "a-z\u00e0-\u00f6\u00f8-\u00ff"
PLAIN, PARTS = re.compile(f"[!-~{_LATIN}]+"), re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


def pieces(column: pa.Array) -> tuple[K.Texts, K.Words]:
    texts = K.texts_of(column)
    if b"<|" not in texts.data.tobytes():
        texts = K.Texts(K.LOWER[texts.data], texts.offsets)
    letter, sign = LETTER[texts.data], SIGN[texts.data]
    cut = np.zeros(len(letter), bool)
    cut[1:] = letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
    return texts, K.words_of(texts, cut=cut)


class WordIds:
    """Ids of words by their 64-bit hashes. Kept between batches; begun anew beyond WORDS_KEPT words."""

    _kept: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def look_up(self, texts: K.Texts, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and length in self.flat of each distinct word, and for each word which distinct one it is."""
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > WORDS_KEPT:
            self.clear()
        new = np.flatnonzero(~K.member(self.keys, distinct)) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            data, s, e = texts.data.tobytes(), words.starts[first[new]].tolist(), words.ends[first[new]].tolist()
            found = [self.encoded([data[a:b].decode() for a, b in zip(s[i : i + AT_ONCE], e[i : i + AT_ONCE])]) for i in range(0, len(s), AT_ONCE)]
            length = np.concatenate([x[1] for x in found])
            start = len(self.flat) + np.cumsum(length) - length
            self.flat = np.concatenate([self.flat, *(x[0] for x in found)])
            at = np.searchsorted(self.keys, distinct[new])
            self.keys, self.start, self.length = np.insert(self.keys, at, distinct[new]), np.insert(self.start, at, start), np.insert(self.length, at, length)
        at = np.searchsorted(self.keys, distinct)
        return self.start[at], self.length[at], which

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has. Plain words go as one text: each of a word's parts ends in an id for the end of a part."""
        parts = [len(PARTS.findall(w)) if PLAIN.fullmatch(w) and "<|" not in w else 0 for w in words]
        together = [w for w, n in zip(words, parts) if n]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(together)], add_special_tokens=False)[0].ids, np.uint32)
        ends, until = np.flatnonzero(self.last[ids]) + 1, np.cumsum([n for n in parts if n], dtype=np.int64)
        if len(ends) != (until[-1] if len(until) else 0) or len(ids) != (ends[-1] if len(ends) else 0):  # no such tokenizer
            parts, ids, ends, until = [0] * len(words), ids[:0], ends[:0], until[:0]
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([w for w, n in zip(words, parts) if not n], add_special_tokens=False)]
        length, plain = np.zeros(len(words), np.int64), np.array(parts) > 0
        length[plain], length[~plain] = np.diff(ends[until - 1], prepend=0), [len(x) for x in alone]
        out, of = np.empty(int(length.sum()), np.uint32), np.repeat(plain, length)
        out[of], out[~of] = ids, np.fromiter(chain.from_iterable(alone), np.uint32)
        return out, length

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and where each document begins."""
        texts, words = pieces(column)
        start, length, which = self.look_up(texts, words)
        end = len(self.flat)
        flat = np.append(self.flat, np.uint32(END_ID))
        start = np.insert(start[which], words.offsets[1:], end)
        length = np.insert(length[which], words.offsets[1:], 1)
        at = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        return flat[_ranges(start, length)], at[words.offsets + np.arange(len(words.offsets))]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def tokenized(docs: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """docs(doc_id, text) -> written doc_id, h (the text's hash), ids (bytes, with the end id)."""
    kind = docs.schema["doc_id"].dataType
    size = id_type(vocabulary)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(path)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                ids, at = words.ids(part.column("text"))
                raw = pa.py_buffer(ids.astype(size))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(at * size.itemsize), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), packed], names=["doc_id", "h", "ids"])
                give_back()

    bound_batches(docs.sparkSession)
    return staged(hashed.mapInArrow(run, f"doc_id {kind.simpleString()}, h long, ids binary"), "token-ids")


def flat_ids(column: pa.Array, size: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of bytes, and where each document begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // size.itemsize if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, size)[at[0] : at[-1]] if data and len(column) else np.zeros(0, size)
    return flat, at - at[0]


def count_ids(ids: DataFrame, vocabulary: int) -> DataFrame:
    """ids (bytes) -> (id, n); one row for each id and task goes into the shuffle."""
    size = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(flat_ids(batch.column("ids"), size)[0], minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(df: DataFrame, to: str, tokenizer: str, vocabulary: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes ``to``/blocks and ``to``/codebook. The vocabulary bounds what the driver holds."""
    spark = df.sparkSession
    docs = tokenized(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), tokenizer, vocabulary)
    counts = np.zeros(vocabulary, np.int64)
    for row in count_ids(docs, vocabulary).collect():
        counts[row["id"]] = row["n"]
    lengths = H.code_lengths(counts)
    spark.createDataFrame([(i, int(lengths[i])) for i in np.flatnonzero(lengths).tolist()], "id int, bits int").coalesce(1).write.parquet(f"{to}/codebook")

    kind, size = docs.schema["doc_id"].dataType, id_type(vocabulary)
    arrow_ids = pa.list_(to_arrow_type(kind))
    codes = H.canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, number = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            (flat, at), begin = flat_ids(batch.column("ids"), size), 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK_IDS, "right")) - 1)
                payload, _, marks = H.encode(flat[at[begin] : at[end]].astype(np.int64), lengths, codes)
                names = batch.column("doc_id").slice(begin, end - begin).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([names], arrow_ids), pa.array([np.diff(at[begin : end + 1])], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                    names=["shard", "block", "first", "doc_ids", "n_tokens", "offsets", "payload"],
                )
                first, number, begin = first + int(at[end] - at[begin]), number + 1, end
            give_back()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h", F.monotonically_increasing_id())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    blocks = ordered.select("doc_id", "ids").mapInArrow(run, f"shard int, block int, first long, doc_ids array<{kind.simpleString()}>, n_tokens array<long>, offsets array<int>, payload binary")
    blocks.write.parquet(f"{to}/blocks")
    drop_staged(docs)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """-> doc_id, start, n_tokens, and ids array<int> or with ``digest`` ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    book = spark.read.parquet(f"{path}/codebook").collect()  # as many rows as the vocabulary at most
    lengths = np.zeros(max([x["id"] for x in book], default=0) + 1, np.uint8)
    for x in book:
        lengths[x["id"]] = x["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = H.decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                names, counts = batch.column("doc_ids")[i].values, batch.column("n_tokens")[i].values.to_numpy()
                at = np.r_[0, np.cumsum(counts)]
                ids = H.decode(batch.column("payload")[i].as_py(), batch.column("offsets")[i].values.to_numpy(), int(at[-1]), decoder)
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                n = len(counts)
                yield pa.RecordBatch.from_arrays([names, pa.array(at[:-1] + batch.column("first")[i].as_py()), pa.array(counts), pa.array(np.full(n, batch.column("shard")[i].as_py(), np.int32)), last], names=["doc_id", "local", "n_tokens", "shard", "out"])

    docs = blocks.select("shard", "first", "doc_ids", "n_tokens", "offsets", "payload").mapInArrow(run, f"doc_id {kind}, local long, n_tokens long, shard int, out {'long' if digest else 'array<int>'}")
    totals = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    base = totals.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # a row for each shard
    return docs.join(F.broadcast(base), F.col("shard") == F.col("s")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", F.col("out").alias("ids_crc32" if digest else "ids"))


def tokenizer_file() -> tuple[str, int]:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), 49408


def token_digests(docs: DataFrame) -> DataFrame:
    """Writes the documents' token files in the shared folder, reads them back and digests them."""
    path, vocabulary = tokenizer_file()
    to = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, to, path, vocabulary)
    return read_token_files(docs.sparkSession, to, digest=True)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
