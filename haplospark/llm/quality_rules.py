"""Quality rules by repetition coverage.

For each text, rolling hashes of several n-gram lengths find the words that lie
in n-grams or lines seen more than once in that text, and the characters they
cover. One pass over Arrow batches; nothing is shuffled, so a hot source or a
group of copies changes nothing.

Defined cases: a null or empty text has no words, so all counts are 0 and it
fails the base rule; repeated rows each give a row; an empty table gives none;
other input columns are ignored unless asked for with ``keep``. A text of any
length is handled whole, in memory proportional to itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm import kernels as K
from haplospark.llm.common import fresh, map_texts, table

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE = np.zeros(256, bool)
LINE[10] = True

#: Largest share of word characters in the most frequent n-gram, by n.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of word characters in n-grams that occur twice or more, by n.
DUPLICATE_SHARE = {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40}
#: Largest share of word characters in lines equal to an earlier line.
LINE_SHARE = 0.30
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"top_{n}_chars" for n in TOP_SHARE), *(f"dup_{n}_chars" for n in DUPLICATE_SHARE)]


def repetition(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a column."""
    texts = K.texts_of(column)
    words = K.words_of(texts)
    n, owner = len(words.starts), words.text
    chars_before = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=chars_before[1:])
    chars = chars_before[words.ends] - chars_before[words.starts]
    out = {"n_words": words.counts, "word_chars": K.sums(chars, words.offsets), "n_symbols": K.sums(SYMBOL[texts.data], texts.offsets)}

    starts, ends = K.spans(texts, LINE)
    word_at = np.searchsorted(words.starts, np.r_[starts, ends])
    first_word, end_word = word_at[: len(starts)], word_at[len(starts) :]
    full = end_word > first_word
    starts, ends, first_word, end_word = starts[full], ends[full], first_word[full], end_word[full]
    line_text = owner[first_word]
    keys = K.per_text(K.span_hashes(texts.data, starts, ends), line_text)
    _, earliest = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[earliest] = False
    word_chars = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=word_chars[1:])
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=texts.n)
    out["dup_line_chars"] = np.bincount(line_text[later], (word_chars[end_word] - word_chars[first_word])[later], minlength=texts.n).astype(np.int64)

    for size in sorted({*TOP_SHARE, *DUPLICATE_SHARE, REPEAT_WINDOW}):
        grams, at = K.ngrams(words.hashes, words.offsets, size)
        keys = K.per_text(grams, owner[at])
        again = K.repeated(keys)
        at, keys = at[again], keys[again]
        if size in TOP_SHARE:
            most = np.zeros(texts.n, np.int64)
            _, one, times = np.unique(keys, return_index=True, return_counts=True)
            np.maximum.at(most, owner[at[one]], times * (word_chars[at[one] + size] - word_chars[at[one]]))
            out[f"top_{size}_chars"] = most
        if size in DUPLICATE_SHARE:
            mask = K.covered(at, size, n)
            out[f"dup_{size}_chars"] = K.sums(chars * mask, words.offsets)
            if size == REPEAT_WINDOW:
                out["n_repeat_words"] = K.sums(mask, words.offsets)
    return out


def repetition_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and one long column for each of COUNTS. Input columns that share a name with one of COUNTS are not kept."""
    whole = fresh(df, "whole_text")
    kept = df.select(*keep, F.col(text).cast("string").alias(whole))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != whole), *(f"{c} long" for c in COUNTS)])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = repetition(batch.column(whole))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(counts[c], pa.int64()) for c in COUNTS], names=[*keep, *COUNTS])

    return map_texts(kept, whole, schema, make)


def verdicts(counts: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    over = F.col("dup_line_chars") > LINE_SHARE * F.col("word_chars")
    for prefix, shares in (("top", TOP_SHARE), ("dup", DUPLICATE_SHARE)):
        for size, share in shares.items():
            over = over | (F.col(f"{prefix}_{size}_chars") > share * F.col("word_chars"))
    return counts.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~over)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = verdicts(repetition_counts(table(spark, sf_dir, "documents")))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *COUNTS[5:])
