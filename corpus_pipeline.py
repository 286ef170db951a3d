"""The corpus pipeline: documents in, token files out.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir)
and works on all that the stage before it kept. All but the last return the
columns of documents. SQL cannot express the stages; tests hold them against
brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import fresh, staged, table
from haplospark.llm.decontaminate import contamination, small
from haplospark.llm.mixing import mixed_rows
from haplospark.llm.near_dedup import without_near_duplicates
from haplospark.llm.token_files import token_digests
from haplospark.llm.toxicity import REJECT, toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score REJECT or more go. Null and empty texts score as a text without a known word and stay unless
    every label is toxic; repeated rows are judged alike; without labels, or without rows, nothing goes."""
    score = fresh(docs, "toxicity")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), docs.columns, out=score)
    return scored.where(F.col(score) < REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id, a null one only if the group has no other, and of equal ids that of
    the least text hash. Texts without words, null ones too, are one group; of rows equal in id and text one stays."""
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go. Null and empty texts stay; a null doc_id is an id like any other; rows
    equal in id and text go or stay together; with an empty benchmark, all stay."""
    d, h = fresh(docs, "found_id"), fresh(docs, "found_hash")
    found = staged(contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("d").alias(d), F.col("h").alias(h)), "contaminated")
    return docs.join(small(found, found.count()), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: none to three times. A null source is a source; null and empty texts have
    no size and follow their source's boundary; rows equal in id and text may differ by one in how often they are taken."""
    return mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32. Each row has a span of its own, also null and empty
    texts (the end id alone) and repeated rows; null ids come first; no rows give an empty file."""
    return token_digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
