"""Quality by positive-unlabelled learning.

Trusted positives (labelled 1) and unlabelled web text fit a small network by
the non-negative unbiased risk: pi * E+[l(f)] + max(0, Eu[l(-f)] - pi * E+[l(-f)]).
The class prior pi is estimated from positives and unlabelled text alone; no
negative label is read. Inputs are dense measures of the text's form, made in
numpy on Arrow batches; scoring is one pass without a shuffle.

Defined cases: null and empty texts have all measures 0 and get a score like
any other; rows that repeat are scored alike; null labels are ignored; without
positives all scores are 0; without documents there are no rows. Very long texts
are read whole; equal scores need no order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm import kernels as K
from haplospark.llm.common import crc_bucket, fresh, map_texts, some_rows, table

#: Bounds of the samples that fit the model: trusted positives, and unlabelled texts.
POSITIVES = UNLABELLED = 15_000
HOLD_OUT, ACCEPT = 5, 0.3


def _class(chars: bytes | range) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


CLASSES = {
    "upper": _class(range(65, 91)), "lower": _class(range(97, 123)), "digit": _class(range(48, 58)), "bang": _class(b"!?"), "stop": _class(b".,;:"), "junk": _class(b"#*$%&<>"),
    "bar": _class(b"|"), "line": _class(b"\n"), "other": _class(b"-_/\\()[]{}=+@^~\"'"), "high": _class(range(128, 256)),
}
MEASURES = [*CLASSES, "log_words", "word_bytes", "long_words", "distinct", "next_same", "again_2", "again_8", "again_lines", "line_words"]


def measures(column: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text: shares of bytes, words and lines."""
    texts = K.texts_of(column)
    words = K.words_of(texts)
    owner, n_bytes, n_words = words.text, np.maximum(np.diff(texts.offsets), 1), np.maximum(words.counts, 1)
    per = lambda values, by: K.sums(values, by)
    out = [per(mask[texts.data], texts.offsets) / n_bytes for mask in CLASSES.values()]
    size = words.ends - words.starts
    same = np.zeros(len(size), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    _, first = np.unique(K.per_text(words.hashes, owner), return_index=True)
    out += [np.log1p(words.counts) / 10, per(size, words.offsets) / n_words / 10, per(size > 20, words.offsets) / n_words]
    out += [np.bincount(owner[first], minlength=texts.n) / np.sqrt(n_words) / 10, per(same, words.offsets) / n_words]
    for n in (2, 8):
        grams, at = K.ngrams(words.hashes, words.offsets, n)
        again = K.repeated(K.per_text(grams, owner[at]))
        out.append(np.bincount(owner[at[again]], minlength=texts.n) / n_words)
    starts, ends = K.spans(texts, CLASSES["line"])
    line_owner = np.searchsorted(texts.offsets, starts, "right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=texts.n), 1)
    again = K.repeated(K.per_text(K.span_hashes(texts.data, starts, ends), line_owner))
    out += [np.bincount(line_owner[again], minlength=texts.n) / lines, np.log1p(words.counts / lines) / 10]
    return np.stack(out, 1).astype(np.float32)


class Network:
    """One hidden layer; plain arrays, so that tasks get it in a closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, parameters: list[np.ndarray]):
        self.mean, self.scale, self.parameters = mean, scale, parameters

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parameters
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, inside: float | None = None, hidden: int = 24, steps: int = 1500, rate: float = 0.01, seed: int = 7) -> Network:
    """Full-batch Adam on the non-negative risk with the logistic loss. Where the
    negative part of the risk falls below 0, its gradient is turned round.
    ``inside``: the share of positives taken out of the unlabelled, ``prior`` if not given; with 0 it
    tells positives from unlabelled."""
    inside = prior if inside is None else inside
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-3, [])
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    p = net.parameters = [rng.normal(0, d**-0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    x = np.clip((both - net.mean) / net.scale, -6, 6).astype(np.float32)
    n = len(positive)
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        s = 1 / (1 + np.exp(-(h @ p[2] + p[3])))
        loss_negative = -np.log(np.maximum(1 - s, 1e-7))
        gap = loss_negative[n:].mean() - inside * loss_negative[:n].mean()
        sign = 1.0 if gap >= 0 else -1.0
        dz = np.empty(len(x), np.float32)
        dz[:n] = (prior * (s[:n] - 1) if gap >= 0 else 0) / n - sign * inside * s[:n] / n
        dz[n:] = sign * s[n:] / (len(x) - n)
        dh = np.outer(dz, p[2]) * (1 - h * h)
        for i, g in enumerate((x.T @ dh + 1e-5 * p[0], dh.sum(0), h.T @ dz + 1e-5 * p[2], dz.sum(keepdims=True))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] -= (rate * (1 - t / steps * 0.9) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.9) -> float:
    """Share of positives among the unlabelled. One half of both tells them apart; on the other, where scores are high,
    hardly any but positives are left, so there the unlabelled share over the positive one comes down to the prior. Taken
    at the threshold whose ratio, with its margin of ``confidence``, is least; within 0.01 to 0.99."""
    parts = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    (p, p_held), (u, u_held) = parts(positive), parts(unlabelled)
    net = fit(p, u, 1.0, inside=0.0, steps=400)
    p_scores, u_scores = np.sort(net.logits(p_held)), np.sort(net.logits(u_held))
    at = np.unique(p_scores)
    above = lambda scores: 1 - np.searchsorted(scores, at, "left") / len(scores)
    margin = sum(np.sqrt(np.log(4 / (1 - confidence)) / (2 * len(s))) for s in (p_scores, u_scores))
    p_above, u_above = above(p_scores), above(u_scores)
    best = np.argmin((u_above + margin) / p_above)
    return float(np.clip(u_above[best] / p_above[best], 0.01, 0.99))


def _measured(docs: DataFrame) -> np.ndarray:
    """docs: a bounded sample."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = measures(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["x"])

    rows = map_texts(docs.select("text"), "text", "x array<float>", make).collect()
    return np.array([r["x"] for r in rows], np.float32).reshape(-1, len(MEASURES))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str], label: str = "quality", text: str = "text") -> DataFrame:
    """docs' columns ``keep`` and score in 0 to 1; a column of that name isn't kept. labels(doc_id, label): those to learn from."""
    keep = [c for c in keep if c.lower() != "score"]
    whole = fresh(docs, "whole_text")
    docs = docs.withColumn(whole, F.col(text).cast("string"))
    plain = docs.select("doc_id", F.col(whole).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    trusted = known.where(F.col("y") == 1).select("doc_id")
    rows = plain.groupBy("doc_id").agg(F.count("*").alias("rows")).join(trusted, "doc_id").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    positive = _measured(some_rows(plain, ["doc_id", "text"], POSITIVES, rows).join(trusted, "doc_id"))
    unlabelled = _measured(some_rows(plain, ["doc_id", "text"], UNLABELLED, plain.count()))
    net = fit(positive, unlabelled, class_prior(positive, unlabelled)) if len(positive) and len(unlabelled) else None
    scored = docs.select(*keep, whole)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = net.logits(measures(batch.column(whole))) if net else np.full(batch.num_rows, -np.inf)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(1 / (1 + np.exp(-z.astype(float))))], names=[*keep, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema if f.name != whole), "score double"])
    return map_texts(scored, whole, schema, make)


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", HOLD_OUT) != 0)
    scores = quality_scores(docs, labels, ["doc_id"])
    return scores.select("doc_id", (crc_bucket("doc_id", HOLD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
