"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Exact copies (equal words, A-Z as a-z) become one class first. Each class has
weighted 5-word shingles: count in the text times a damped inverse document
frequency over all classes, 1 + ln(1 + N/df) / (2 ln(1 + N)), in steps of 1/32.
A class of which less than 0.8 of the shingles and of the weight is found in
other classes too can have no link and goes no further: this is exact. BANDS of
ROWS samples each put the others into buckets. Pairs from buckets are verified:
they are linked if the weighted Jaccard similarity, or that of the plain sets,
is 0.8 or more. (In a large group of copies, shared shingles weigh less than a
copy's own, and the weighted similarity alone would part plain copies.) A
document's class is its component over the links.

No bucket is expanded into all its pairs. First each member meets the bucket's
leader, whose shingles are the most common. Two members become a pair only if
sizes, what each has alone, and 512-bit sketches allow a similarity of 0.8 (see
``may_match``: an exact bound, no link is lost). Then, while a bucket holds
members of several components, those outside its largest one meet all others, a
growing share of them each round, until every pair of members in different
components was tested or ruled out.

Defined cases: texts without words, null ones too, are copies of each other; a
text of fewer than five words has one shingle, all its words; rows that repeat
are copies; null and repeated ids are rows like any other; texts of any length
count whole; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm import kernels as K
from haplospark.llm.chunks import CHUNK_BYTES, chunk_of, chunked, count_everywhere, counts_in_order, pack, unpack
from haplospark.llm.common import drop_staged, fresh, give_back, staged, table
from haplospark.llm.components import components

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 12, 4
IDF_STEPS = 32
#: New leaders of a bucket in the first round after the leader's, and the factor by which they grow; all members lead
#: at once where that makes PAIRS_A_ROW pairs to look at for each row of the buckets.
FIRST, GROW, PAIRS_A_ROW = 32, 32, 8
IDS_BITS = 20
BROADCAST_ROWS = 100_000
#: Of a class: number of shingles and sum of weights; the same for those that no other class has; the mean binary logarithm of
#: their document frequencies, in steps of 1/1024; and a sketch with a bit for each value of the first bits of the shared ones.
SKETCH_BITS = 9
SKETCH_WORDS = (1 << SKETCH_BITS) // 64
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
ABOUT = ["n", "total", "n_alone", "alone", "common", *SKETCH]

_rng = np.random.default_rng(5)
SEEDS = _rng.integers(1, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_u = (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1): the root of 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return low


GAMMA = _gamma2(_u).astype(np.float32)
LOG_GAMMA = np.log(GAMMA)


def text_hashes(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's sequence of words."""
    n = len(chunk.stream)
    out = []
    for salt in (1, 2):
        total = np.zeros(n + 1, np.uint64)
        h = K.mix(chunk.words + np.uint64(salt))[chunk.stream]
        np.cumsum(h * K.powers(int(K.WORD_BASE), n), out=total[1:])
        inverse = K.powers_at(pow(int(K.WORD_BASE), -1, 2**64), chunk.offsets[:-1])
        out.append(K.mix((total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]) * inverse + np.diff(chunk.offsets).astype(np.uint64)))
    return out[0], out[1]


def shingles(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the chunk's representatives, in order of both."""
    chunk = chunk_of(row)
    counts = np.diff(chunk.offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    grams, at = K.ngrams(chunk.hashes, chunk.offsets, SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    first, _ = text_hashes(chunk)
    docs, keys = np.concatenate([owner[at], short]), np.concatenate([grams, first[short]])
    mask = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=len(counts)).astype(bool)[docs]
    docs, keys = docs[mask], keys[mask]
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]) if len(docs) else np.zeros(0, np.int64)
    return docs[first], keys[first], np.diff(np.r_[first, len(docs)])


def document_frequencies(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(row)[1], return_counts=True)


def weighted(row: dict, frequencies: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight in whole numbers of 1/32, document frequency)."""
    docs, keys, tf = shingles(row)
    _, which = np.unique(keys, return_inverse=True)
    idf = np.rint(IDF_STEPS * (1 + np.log1p(n / np.maximum(frequencies, 1)) / (2 * np.log1p(n)))).astype(np.int64)
    return docs, keys, tf * idf[which], frequencies[which]


def signatures(docs: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their band hashes. The element with the least a is the sample:
    ln a = ln c - r (t - beta) - r with t = floor(ln w / r + beta)."""
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    bands = np.zeros((len(starts), BANDS), np.uint64)
    if not len(starts):
        return docs[starts], bands
    sizes, log_w = np.diff(np.r_[starts, len(docs)]), np.log(weights).astype(np.float32)
    number = np.repeat(np.arange(len(starts)), sizes)
    for k, (a, b) in enumerate(SEEDS):
        h = (keys ^ b) * a
        h ^= h >> np.uint64(31)
        h *= b
        h ^= h >> np.uint64(32)
        low = h.view(np.uint16).reshape(-1, 4)
        r, beta = GAMMA[low[:, 0]], low[:, 2].astype(np.float32) * np.float32(2**-16) + low[:, 3].astype(np.float32) * np.float32(2**-32)
        t = np.floor(log_w / r + beta)
        log_a = LOG_GAMMA[low[:, 1]] - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == least[number])
        at = at[np.r_[True, number[at[1:]] != number[at[:-1]]]]
        bands[:, k // ROWS] = K.mix(bands[:, k // ROWS] * K.WORD_BASE + keys[at] + t[at].astype(np.int64).astype(np.uint64))
    return docs[starts], bands


def similarity(a: tuple[np.ndarray, np.ndarray, int, int], b: tuple[np.ndarray, np.ndarray, int, int]) -> float:
    """The larger of the weighted Jaccard similarity and that of the plain sets, from sorted keys that others have too, their
    weights, and the number and weight of all keys; 32 bits of a shingle's hash tell shingles of two texts apart."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared, both = np.minimum(a[1][same], b[1][at[same]]).sum(), same.sum()
    return max(shared / max(a[3] + b[3] - shared, 1), both / max(a[2] + b[2] - both, 1))


def about(docs: np.ndarray, keys: np.ndarray, weights: np.ndarray, frequencies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, where each begins, and their columns ABOUT. docs is sorted; frequencies are of each key."""
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    if not len(starts):
        return docs, starts, np.zeros((0, len(ABOUT)), np.int64)
    sizes, alone = np.diff(np.r_[starts, len(docs)]), frequencies < 2
    owner, shared = np.repeat(np.arange(len(starts)), sizes), ~alone
    bits = np.zeros((len(starts), 64 * SKETCH_WORDS), bool)
    bits[owner[shared], (keys[shared] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] = True
    total = np.add.reduceat(weights, starts)
    common = np.rint(1024 * np.add.reduceat(weights * np.log2(frequencies), starts) / total).astype(np.int64)
    columns = [sizes, total, np.add.reduceat(alone.astype(np.int64), starts), np.add.reduceat(weights * alone, starts), common]
    return docs[starts], starts, np.column_stack([*columns, np.packbits(bits, axis=1).view(np.int64).reshape(-1, SKETCH_WORDS)])


def may_match(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether two classes can have a similarity of SIMILAR, by their columns ABOUT. Apart are what either has alone in the
    corpus, and for each bit that differs a shingle more, of weight IDF_STEPS at least; a similarity of s allows (1 - s) / (1 + s) of the sum."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(x(c).bitwiseXOR(y(c))) for c in SKETCH])

    def near(size: str, alone: str, least: int) -> Column:
        apart = F.greatest(F.abs(x(size) - y(size)), x(alone) + y(alone) + least * differ)
        return apart * (1 + SIMILAR) <= (x(size) + y(size)) * (1 - SIMILAR) + 1e-3

    return near("n", "n_alone", 1) | near("total", "alone", IDF_STEPS)


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class NearDuplicates:
    """The steps over one table; ``classes`` is the result."""

    def __init__(self, docs: DataFrame):
        """docs(doc_id, text)."""
        self.chunks = chunked(docs.select("doc_id", "text", F.lit(0).alias("role"), F.xxhash64("text").alias("mark")), "dedup-chunks", lambda chunk: [h.view(np.int64) for h in text_hashes(chunk)], ("h1s", "h2s"), CHUNK_BYTES // 2)
        each = self.chunks.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "marks", "h1s", "h2s")).alias("place", "d"))
        #: rid (chunk and place), doc_id, mark (hash of the text as it is), h1, h2 for each row
        self.members = each.select((F.shiftleft("chunk", IDS_BITS) + F.col("place")).alias("rid"), F.col("d.doc_ids").alias("doc_id"), F.col("d.marks").alias("mark"), F.col("d.h1s").alias("h1"), F.col("d.h2s").alias("h2"))
        self.copies = staged(self.members.groupBy("h1", "h2").agg(F.min("rid").alias("rep")), "dedup-copies")
        self.n = self.copies.count()
        masked = self._masked()
        frequencies, _ = count_everywhere(masked, document_frequencies, ((0,),), "dedup-frequencies")
        #: rid, keys, weights (of shingles that other classes have too), bands, ABOUT
        self.vectors = staged(self._vectors(masked, frequencies), "dedup-vectors")
        drop_staged(frequencies)

    def _masked(self) -> DataFrame:
        """Chunks with a bit for each document: whether it stands for its copies."""
        place = F.col("rep") - F.shiftleft(F.shiftright("rep", IDS_BITS), IDS_BITS)
        by_chunk = self.copies.groupBy(F.shiftright("rep", IDS_BITS).alias("c")).agg(F.collect_list(place.cast("int")).alias("places"))  # a chunk's documents

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, places in zip(batch.column("c").to_pylist(), batch.column("places").to_pylist()):
                    bits = np.zeros(max(places) + 1, np.uint8)
                    bits[places] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["c", "mask"])

        masks = staged(by_chunk.mapInArrow(run, "c long, mask binary"), "dedup-masks")
        # masks have a bit a class: broadcast while all are a few megabytes
        few = F.broadcast(masks) if self.n <= 64 * BROADCAST_ROWS else masks
        return self.chunks.join(few, F.col("chunk") == F.col("c"), "left").select("chunk", "role", "counts", "words", "stream", F.coalesce("mask", F.lit(b"")).alias("mask"))

    def _vectors(self, chunks: DataFrame, frequencies: DataFrame) -> DataFrame:
        """Classes that can be like another: at least SIMILAR of their shingles or weights are found in other classes too."""
        n = self.n

        def make(row: dict, packed: pa.Table) -> pa.Table:
            docs, keys, weights, df = weighted(row, counts_in_order(packed, "counts_0"), n)
            which, starts, columns = about(docs, keys, weights, df)
            size, total, n_alone, alone = columns.T[:4]
            able = (size - n_alone >= SIMILAR * size - 1e-3) | (total - alone >= SIMILAR * total - 1e-3)
            of = np.repeat(able, size)
            _, bands = signatures(docs[of], keys[of], weights[of])
            out: list = [[], []]
            for a, b in zip(starts[able], (starts + size)[able]):
                other = df[a:b] > 1
                out[0].append((keys[a:b][other] >> np.uint64(32)).astype(np.uint32).tobytes())
                out[1].append(pack(weights[a:b][other].astype(np.uint32)))
            salted = K.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            rid = (row["chunk"] << IDS_BITS) + which[able]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rid) + 1) * BANDS, pa.int32()), pa.array(salted.ravel()))
            return pa.table([pa.array(rid, pa.int64()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), lists, *map(pa.array, columns[able].T)], names=["rid", "keys", "weights", "bands", *ABOUT])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            none = pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * len(ABOUT))], names=["rid", "keys", "weights", "bands", *ABOUT])
            out = pa.concat_tables([none, *(make(row, right) for row in left.to_pylist())])
            give_back()
            return out

        return chunks.groupBy("chunk").cogroup(frequencies.groupBy("chunk")).applyInArrow(run, "rid long, keys binary, weights binary, bands array<long>, " + ", ".join(f"{c} long" for c in ABOUT))

    def buckets(self) -> DataFrame:
        """rid, bucket, x (ABOUT): buckets of two classes or more."""
        each = self.vectors.select("rid", F.explode("bands").alias("bucket"))
        shared = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("bucket", "k")
        x = self.vectors.select(F.col("rid").alias("v"), F.struct(*ABOUT).alias("x"))
        return each.join(shared, F.col("bucket") == F.col("k")).join(small(x, self.vectors.count()), F.col("rid") == F.col("v")).select("rid", "bucket", "x")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) -> written a, b, similarity."""
        pairs = staged(pairs, "dedup-pairs")
        few, about = small(pairs, pairs.count()), [F.col("n"), F.col("total")]

        def side(end: str) -> DataFrame:
            vectors = self.vectors.select(F.col("rid").alias("r"), F.struct("keys", "weights", *about).alias(f"v{end}"))
            return vectors.join(few, F.col("r") == F.col(end)).drop("r")

        right = side("b").withColumnsRenamed({"a": "a2", "b": "b2"})
        both = side("a").join(right, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).select("a", "b", "va", "vb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = lambda v: (np.frombuffer(v["keys"], np.uint32), unpack(v["weights"]).astype(np.int64), v["n"], v["total"])
            for batch in batches:
                found = [similarity(read(batch.column("va")[i].as_py()), read(batch.column("vb")[i].as_py())) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
                give_back()

        tested = staged(both.mapInArrow(run, "a long, b long, similarity double"), "dedup-tested")
        drop_staged(pairs)
        return tested

    def links(self) -> DataFrame:
        """Links found between classes: a, b. Every pair of a bucket is linked, or in one component, or was tested or ruled out by may_match."""
        buckets = staged(self.buckets(), "dedup-buckets")
        rows = buckets.count()
        own, other = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
        first = F.struct(F.col("x.common").alias("common"), F.col("rid").alias("rid"), F.col("x").alias("x"))
        leader = buckets.groupBy("bucket").agg(F.max(first).alias("lead")).select(F.col("bucket").alias("k"), F.col("lead.rid").alias("l"), F.col("lead.x").alias("y"))
        ends = F.least("rid", "l").alias("a"), F.greatest("rid", "l").alias("b")
        pairs = buckets.join(leader, (F.col("bucket") == F.col("k")) & (F.col("l") != F.col("rid")) & may_match(own, other)).select(*ends).distinct()
        tested = self.verify(pairs)
        similar = lambda df: df.where(F.col("similarity") >= SIMILAR).select("a", "b")
        links, leaders = similar(tested), FIRST
        while True:
            joined = staged(components(links), "dedup-components").withColumnsRenamed({"node": "n", "component": "c"})
            placed = buckets.join(small(joined, joined.count()), F.col("rid") == F.col("n"), "left").select("rid", "bucket", "x", F.coalesce("c", "rid").alias("component"))
            sized = placed.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top"))
            sized = staged(sized.where("parts > 1").select(F.col("bucket").alias("k"), F.col("all"), F.col("top.component").alias("main"), (F.col("all") - F.col("top.m")).alias("minor")), "dedup-sizes")
            # what is joined already is a star to the next round
            links = joined.select(F.col("n").alias("a"), F.col("c").alias("b"))
            most, pairs = sized.agg(F.max("minor"), F.sum(F.col("minor") * F.col("all"))).first()
            if not most:
                return links
            if pairs <= PAIRS_A_ROW * rows:
                leaders = most
            open_ = staged(placed.join(small(sized, sized.count()), F.col("bucket") == F.col("k")).drop("k"), "dedup-open")
            some = F.pmod(F.xxhash64("rid"), F.lit(1 << 40)) * F.col("minor") <= F.lit(leaders) * F.lit(float(1 << 40))
            lead = open_.where((F.col("component") != F.col("main")) & some).select(F.col("bucket").alias("k"), F.col("rid").alias("l"), F.col("component").alias("lc"), F.col("x").alias("y"))
            met = open_.join(lead, (F.col("bucket") == F.col("k")) & (F.col("component") != F.col("lc")) & may_match(own, other)).select(*ends).distinct()
            result = self.verify(met.join(tested.select(F.col("a").alias("ta"), F.col("b").alias("tb")), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"))
            tested, links = tested.unionByName(result), links.unionByName(similar(result))
            drop_staged(open_)
            if leaders >= most:
                return links
            leaders *= GROW

    def classes(self) -> DataFrame:
        """rid, doc_id, mark (hash of its text), class (its least rid), class_size, and class_id and class_mark, which are the least doc_id and
        mark of the class (a null id only if it has no other) and together name it: one row for each row."""
        found = staged(components(self.links()), "dedup-components")
        few = small(found, found.count())
        by_copy = self.copies.join(few, F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.coalesce("component", "rep").alias("class"))
        rows = staged(self.members.join(by_copy, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))).select("rid", "doc_id", "mark", "class"), "dedup-classes")
        name = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "mark")).alias("name")
        about = rows.groupBy("class").agg(name, F.count("*").alias("class_size")).select(F.col("class").alias("c"), F.col("name.doc_id").alias("class_id"), F.col("name.mark").alias("class_mark"), "class_size")
        drop_staged(self.vectors)
        return rows.join(about, F.col("class") == F.col("c")).drop("c")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class stays: that of the least (doc_id, text hash), a null id only if the class has no other. Rows to drop are
    named by both, so rows equal in both are told apart by a last distinct over these alone. Null texts are one class with other
    texts without words; columns of any name pass through."""
    rows = NearDuplicates(docs.select("doc_id", "text")).classes()
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    d, m = fresh(docs, "judged_id"), fresh(docs, "judged_mark")
    judged = staged(rows.groupBy("class", "doc_id", "mark").agg(F.count("*").alias("times"), F.max(stays).alias("stays")).select(F.col("doc_id").alias(d), F.col("mark").alias(m), "times", "stays"), "dedup-judged")
    same = docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(m))
    drop, again = judged.where(~F.col("stays")).select(d, m), judged.where(F.col("stays") & (F.col("times") > 1)).select(d, m)
    kept = docs.join(small(drop, drop.count()), same, "left_anti")
    n = again.count()
    if not n:
        return kept
    once = kept.join(small(again, n), same, "left_semi").withColumn(m, F.xxhash64("text")).dropDuplicates(["doc_id", m]).drop(m)
    return kept.join(small(again, n), same, "left_anti").unionByName(once)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).classes().select("doc_id", "class_id", "class_size", "class_mark")
