"""Toxicity by noisy-channel deobfuscation.

A character trigram model of all documents judges what an odd token was meant
to be: leet signs, repeated letters, separators and spaces between short
pieces form a lattice over each odd token, and Viterbi picks its best path.
Odd are words with a repeated letter, a sign or a separator, and runs of two or
more pieces of at most two characters; what stands there as it is counts too,
unless signs are inside it.
The restored words are then scored by a logistic model over words and word
beginnings, selected and fitted on a bounded sample of labelled rows.

Defined cases: null and empty texts have no words and get the score of a text
without any known word; rows that repeat are scored alike; labels that are null
are ignored; documents without labels in training still get scores; with no
labels of either class all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm import kernels as K
from haplospark.llm.common import crc_bucket, fresh, give_back, map_texts, some_rows, staged, table, text_slices

#: So many labelled rows of each class fit the model.
SAMPLE_ROWS = 12_000
#: So many words and word beginnings are its features.
FEATURES = 768
PREFIXES = (3, 4, 5, 6, 7)

# What signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_*~'’,/\\:;^=#\"`·•"
#: Behind a word these end sentences and brackets, whatever they stand for elsewhere.
ENDS = "!?.,;:|+()[]{}<>\"'’`*~-_…"
#: Natural log costs of the channel.
SWAP, DROP_REPEAT, DROP_SEPARATOR, DROP_SPACE, KEEP_SIGN = 1.0, 0.7, 0.7, 0.7, 6.0

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
STRIP = ~(LETTER | DIGIT)
#: Classes of the character model: 0 for what isn't a letter, 1-26, and 27 for other alphabets.
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27
N_CLASS = 28


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of 3 consecutive character classes in all texts; 28**3 numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CLASS**3, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = K.texts_of(part.column("text"))
                c = CLASS[texts.data]
                inside = np.ones(max(len(c) - 2, 0), bool)  # three characters of one text
                for back in (1, 2):
                    at = texts.offsets[1:-1] - back
                    inside[at[(at >= 0) & (at < len(inside))]] = False
                total += np.bincount(((c[:-2] * N_CLASS + c[1:-1]) * N_CLASS + c[2:])[inside], minlength=len(total)) if len(inside) else 0
                give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(N_CLASS**3, np.int64)
    for row in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the bigram and a uniform share."""
    c = counts.reshape(N_CLASS, N_CLASS, N_CLASS).astype(float)
    two = (c.sum(0) + 1) / (c.sum(0) + 1).sum(-1, keepdims=True)
    return np.log((c + 20 * two) / (c.sum(-1, keepdims=True) + 20))


class Restorer:
    """Viterbi over the lattice of one odd token or spaced run; the state is the last two characters."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.restore = lru_cache(1 << 16)(self._restore)

    def options(self, seen: str, i: int) -> list[tuple[str, float]]:
        c = seen[i]
        out = [(c, 0.0)] if c.isalpha() else []
        if c in LEET:
            out += [(x, SWAP) for x in LEET[c]] + [(c, KEEP_SIGN)]
        if i and c == seen[i - 1]:
            out.append(("", DROP_REPEAT if i > 1 and c == seen[i - 2] or c in LEET else 3 * DROP_REPEAT))
        if c in SEPARATORS:
            out += [("", DROP_SEPARATOR), (" ", KEEP_SIGN)]
        if c == " ":
            out += [("", DROP_SPACE), (" ", DROP_SPACE)]
        return out or [(c, 0.0)]

    def _restore(self, seen: str) -> str:
        best: dict = {(0, 0): (0.0, None)}  # a path is (what came before, what it puts), so that steps don't copy texts
        for i in range(len(seen)):
            after: dict = {}
            for put, cost in self.options(seen, i):
                k = int(CLASS[ord(put)]) if put and ord(put) < 128 else 27
                for (a, b), (total, path) in best.items():
                    new = (a, b) if not put else (b, k)
                    value = total - cost + (self.model[a][b][k] if put else 0.0)
                    if new not in after or value > after[new][0]:
                        after[new] = (value, (path, put) if put else path)
            best = after
        path = max(((v + self.model[a][b][0], -i, p) for i, ((a, b), (v, p)) in enumerate(best.items())), key=lambda x: x[:2])[2]
        out = []
        while path:
            path, put = path
            out.append(put)
        return "".join(reversed(out))


def _strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds without signs at either end; a word of signs alone becomes empty. One pass, however long a run of signs is."""
    if not len(starts):
        return starts, ends
    n, kept = len(data), ~STRIP[data]
    first = np.minimum.accumulate(np.where(kept, np.arange(n), n)[::-1])[::-1][starts]
    last = np.maximum.accumulate(np.where(kept, np.arange(n), -1))[ends - 1] + 1
    some = first < ends
    return np.where(some, first, starts), np.where(some, last, starts)


def _odd(texts: K.Texts, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words with a letter that hold a leet sign, a separator or a repeated letter, and those of them with signs inside.
    Of signs behind the last letter only @ and $ count: others end sentences."""
    data = texts.data
    starts, ends = _strip(data, words.starts, words.ends)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    count = lambda t, a, b: t[np.maximum(b, a)] - t[a]
    low = K.LOWER[data]
    double = np.zeros(len(data), bool)
    double[1:] = (low[1:] == low[:-1]) & (data[1:] < 128) & LETTER[data[1:]]
    signs, like_letters = total(SIGN[data]), total((data == ord("@")) | (data == ord("$")))
    has = (count(total(LETTER[data]), words.starts, words.ends) > 0) & (ends > starts)
    inside = has & (count(total(SIGN[data] | (STRIP[data] & ~K.SPACE[data])), starts, ends) > 0)
    edge = (count(signs, words.starts, starts) > 0) | (count(like_letters, ends, words.ends) > 0)
    return inside | has & (edge | (count(total(double), np.minimum(starts + 1, ends), ends) > 0)), inside


def _spaced(texts: K.Texts, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and the one after the last of each run of two or more words of at most two characters, in one text, of which at least
    one is a letter and three are letters or signs that may stand for one."""
    if not len(words.starts):
        return words.starts, words.starts
    data = texts.data
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    first_byte = (data & 0xC0) != 0x80
    characters, letters, all_of = total(first_byte), total(LETTER[data] & first_byte), total((LETTER | SIGN)[data] & first_byte)
    short = characters[words.ends] - characters[words.starts] <= 2
    new_text = words.text[1:] != words.text[:-1]
    begins, stops = short.copy(), short.copy()
    begins[1:] &= ~short[:-1] | new_text
    stops[:-1] &= ~short[1:] | new_text
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    inside = lambda t: t[words.ends[b - 1]] - t[words.starts[a]]
    real = (b - a >= 2) & (inside(letters) > 0) & (inside(all_of) >= 3)
    return a[real], b[real]


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows: the whole word, then its beginnings of PREFIXES bytes (0 if it is shorter)."""
    starts, ends = _strip(data, starts, ends)
    out = [np.where(ends > starts, K.span_hashes(data, starts, ends), 0)]
    for size in PREFIXES:
        cut = np.minimum(starts + size, ends)
        out.append(np.where(ends - starts >= size, K.mix(K.span_hashes(data, starts, cut) + np.uint64(size)), 0))
    return np.stack(out)


def document_features(column: pa.Array, restorer: Restorer, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the restored texts, each once; with ``known`` (sorted) only those."""
    texts = K.texts_of(column, lower=True)
    words = K.words_of(texts)
    owner = words.text
    _, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    one = K.Words(words.starts[first], words.ends[first], None, None)
    odd, signs_inside = _odd(texts, one) if len(first) else (np.zeros(0, bool),) * 2
    features = _features(texts.data, one.starts, one.ends)
    features[:, signs_inside] = 0
    raw = texts.data.tobytes()
    extra_text, extra_word = [], []

    def put(seen: str, owners: list[int]) -> None:
        for word in restorer.restore(seen).split():
            extra_text.extend(owners)
            extra_word.extend([word.encode()] * len(owners))

    at = np.flatnonzero(odd[which]) if len(which) else np.zeros(0, np.int64)
    order = at[np.argsort(which[at], kind="stable")]
    for group in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []:
        word = first[which[group[0]]]
        seen = raw[words.starts[word] : words.ends[word]].decode()
        put(seen.rstrip(ENDS), owner[group].tolist())
    for a, b in zip(*_spaced(texts, words)):
        put(" ".join(raw[words.starts[a] : words.ends[b - 1]].decode().split()), [int(owner[a])])

    if known is not None:
        features = np.where(K.member(known, features.ravel()).reshape(features.shape), features, 0) if len(known) else np.zeros_like(features)
    any_of = features.any(0)
    at = np.flatnonzero(any_of[which]) if len(which) else np.zeros(0, np.int64)
    pairs_text, pairs = np.repeat(owner[at], len(features)), features[:, which[at]].T.ravel()
    if extra_word:
        size = np.fromiter(map(len, extra_word), np.int64)
        ends = np.cumsum(size)
        more = _features(np.frombuffer(b"".join(extra_word), np.uint8), ends - size, ends)
        if known is not None:
            more = np.where(K.member(known, more.ravel()).reshape(more.shape), more, 0) if len(known) else np.zeros_like(more)
        pairs_text, pairs = np.r_[pairs_text, np.repeat(np.array(extra_text), len(more))], np.r_[pairs, more.T.ravel()]
    real = pairs != 0
    pairs_text, pairs = pairs_text[real], pairs[real]
    _, once = np.unique(K.per_text(pairs, pairs_text), return_index=True)
    return pairs_text[once], pairs[once]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` training ids of each class, by the hash of the id, and at most twice as many rows where ids repeat: (text, y).
    The sample's ids are few, so they are broadcast."""
    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}  # two classes
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= min(1.0, rows / n) * (1 << 30)))
    ids = F.broadcast(clean.where(keep))
    found = {r["y"]: r["count"] for r in docs.select("doc_id").join(ids, "doc_id").groupBy("y").count().collect()}
    sample = docs.select("doc_id", "text").join(ids, "doc_id").select("text", "y")
    parts = [some_rows(sample.where(F.col("y") == y), ["text"], 2 * rows, n) for y, n in found.items() if n > 2 * rows]
    rest = sample.where(~F.col("y").isin([y for y, n in found.items() if n > 2 * rows])) if parts else sample
    for part in parts:
        rest = rest.unionByName(part)
    return rest


def fit(sample: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted), their weights and the bias. sample: as from labelled_sample, so bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in text_slices(batch, "text"):
                text, feature = document_features(part.column("text"), restorer)
                order = np.argsort(text, kind="stable")
                offsets = np.searchsorted(text[order], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature[order].view(np.int64)))], names=["y", "f"])
                give_back()

    rows = staged(sample.mapInArrow(run, "y int, f array<long>"), "toxicity-sample")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return np.zeros(0, np.uint64), np.zeros(0), 30.0 if n.get(1) else -30.0
    counted = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count("*").alias("all"))
    rate = lambda k, m: (k + 0.5) / (m + 1.0)
    odds = F.log(rate(F.col("pos"), n[1]) / rate(F.col("all") - F.col("pos"), n[0]))
    top = counted.where(F.col("pos") >= 4).withColumn("gain", F.col("pos") * odds).where(odds > 1.5).orderBy(F.desc("gain"), "f").limit(FEATURES).select("f")
    known = np.sort(np.array([r["f"] for r in top.collect()], np.int64).view(np.uint64))
    if not len(known):
        return known, np.zeros(0), float(np.log(rate(n[1], 0) / rate(n[0], 0)))
    chosen = F.array(*[F.lit(int(x)) for x in known.view(np.int64)])
    found = rows.select("y", F.array_intersect("f", chosen).alias("f")).groupBy("y", F.array_sort("f").alias("f")).count().collect()
    x = np.zeros((len(found), len(known)), np.float32)
    for i, r in enumerate(found):
        x[i, np.searchsorted(known, np.array(r["f"], np.int64).view(np.uint64))] = 1
    y, w = np.array([r["y"] for r in found], float), np.array([r["count"] for r in found], float)
    weight, bias = logistic(x, y, w / w.sum(), 1e-5)
    return known, weight, bias


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss; weights stay 0 or above: no word excuses another."""
    theta, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    theta[-1] = -2
    for t in range(1, steps + 1):
        z = x @ theta[:-1].astype(np.float32) + theta[-1]
        d = w * (1 / (1 + np.exp(-z)) - y)
        g = np.r_[x.T @ d.astype(np.float32) + l2 * theta[:-1], d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta[:-1], float(theta[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str], label: str = "toxic", text: str = "text", out: str = "score") -> DataFrame:
    """docs' columns ``keep`` and ``out``, a name not among them. labels(doc_id, label): those to learn from."""
    whole = fresh(docs, "whole_text")
    docs = docs.withColumn(whole, F.col(text).cast("string"))
    plain = docs.select("doc_id", F.col(whole).alias("text"))
    model = character_model(trigram_counts(plain))
    known, weight, bias = fit(labelled_sample(plain, labels, label, SAMPLE_ROWS), model)
    scored = docs.select(*keep, whole)
    restorers: list[Restorer] = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not restorers:
            restorers.append(Restorer(model))
        owner, feature = document_features(batch.column(whole), restorers[0], known)
        z = np.full(batch.num_rows, bias)
        if len(known):
            z += np.bincount(owner, weight[np.searchsorted(known, feature)], minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*keep, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema if f.name in keep), f"`{out}` double"])
    return map_texts(scored, whole, schema, make)


HOLD_OUT, HELD, REJECT = 3, 1, 0.7


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", HOLD_OUT) != HELD)
    scores = toxicity_scores(docs, labels, ["doc_id"])
    return scores.select("doc_id", (crc_bucket("doc_id", HOLD_OUT) == HELD).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
