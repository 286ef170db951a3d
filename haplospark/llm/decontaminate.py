"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Postings (term, document, position) of the training words that occur in the
benchmark are stored. For each benchmark window the lists of its two rarest
terms, moved by their offsets, are intersected; what is left is checked
against the lists of all the window's terms, so matches are exact. ``proximity``
relaxes the offsets of the two rarest terms by a slop.

Scale: postings are written where they are read, without a shuffle; lists meet
by hashes of (document, window, start), which spreads a frequent term. The
benchmark's terms and the documents with candidates are broadcast only while
counted below a bound, and joined by a shuffle beyond it.

Defined cases: a null text has no words; a null doc_id is an id of its own;
rows with equal doc_id and text are one document to the index and each get its
result; an empty benchmark contaminates nothing; items without words are
ignored, a null item_id counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.llm.common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII without digits and a-z. Named one by one, the class is a table look-up to Java; ranges are tried in turn.
GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not (48 <= c < 58 or 97 <= c < 123)) + "]+"
#: Stands after a document's last word in its postings; no word has this character.
END = "\x00"
WINDOW_WORDS = 10
#: Rows of the small side of a join that may be broadcast.
BROADCAST_ROWS = 500_000


def lower_az(text: Column) -> Column:
    """A-Z to a-z; other letters stay. ASCII texts take the fast way."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def pieces_of(text: Column) -> Column:
    """The words, with an empty one at an end where the text has a gap there."""
    return F.split(lower_az(F.coalesce(text, F.lit(""))), GAP)


def words_of(text: Column) -> Column:
    return F.filter(pieces_of(text), lambda w: w != "")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """-> item_id string, window, words array. An item shorter than ``size`` is one window."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))).alias("at"))
    return each.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("words")).distinct().withColumn("window", F.xxhash64("item_id", "words"))


class PositionalIndex:
    """Stored postings of a vocabulary: doc_id, text_hash, pos, term (the word's 64-bit hash). Positions count from a
    document's first piece. ``lengths`` has each row's number of words."""

    def __init__(self, df: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        """vocabulary(word): distinct."""
        end = df.sparkSession.createDataFrame([(END,)], "v string")
        terms = vocabulary.select(F.col("word").alias("v")).unionByName(end).withColumn("term", F.xxhash64("v"))
        cut = df.select(*key(doc_id, text), pieces_of(F.col(text)).alias("w"))
        empty = lambda i: (F.element_at("w", i) == "").cast("int")
        n = F.size("w") - empty(1) - F.when(F.size("w") > 1, empty(-1)).otherwise(0)
        each = cut.select("doc_id", "text_hash", n.alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word")).withColumn("h", F.xxhash64("word"))
        known = each.join(small(terms, vocabulary.count()), (F.col("h") == F.col("term")) & (F.col("word") == F.col("v")))
        stored = staged(known.select("doc_id", "text_hash", "n_words", "pos", "term"), "postings")
        last = F.xxhash64(F.lit(END))
        self.lengths = stored.where(F.col("term") == last).select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
        self.postings = stored.where(F.col("term") != last).select("doc_id", "text_hash", "pos", "term")
        self.frequencies = self.postings.groupBy("term").agg(F.count("*").alias("n"))

    def anchors(self, windows: DataFrame, lists: int) -> tuple[DataFrame, DataFrame]:
        """windows(window, words) -> (window, term, offset, length) of each window's rarest terms, and of
        all its terms. A window with a term that the corpus lacks can't occur and is left out."""
        each = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word")).distinct()
        each = each.select("window", "length", "offset", F.xxhash64("word").alias("term"))
        known = each.join(self.frequencies, "term", "left")
        by_rarity = Window.partitionBy("window").orderBy(F.col("n").asc(), "offset")
        ranked = known.withColumn("rank", F.row_number().over(by_rarity)).withColumn("known", F.count("n").over(Window.partitionBy("window")))
        ranked = staged(ranked.where(F.col("known") == F.col("length")).drop("known"), "anchors")
        return ranked.where(F.col("rank") <= lists).select("window", "term", "offset", F.least(F.col("length"), F.lit(lists)).alias("need")), ranked.select("window", "term", "offset", "length")

    def candidates(self, rarest: DataFrame) -> DataFrame:
        """Places where the lists of the rarest terms, moved by their offsets, meet."""
        lists = self.postings.join(small(rarest, rarest.count()), "term").select("doc_id", "text_hash", "window", (F.col("pos") - F.col("offset")).alias("start"), "offset", "need")
        met = lists.where("start >= 0").groupBy("doc_id", "text_hash", "window", "start").agg(F.count_distinct("offset").alias("n"), F.max("need").alias("need"))
        return met.where("n = need").select("doc_id", "text_hash", "window", "start")

    def phrases(self, windows: DataFrame, lists: int = 2) -> DataFrame:
        """Exact matches: doc_id, text_hash, window, start, length."""
        rarest, every = self.anchors(windows, lists)
        found = staged(self.candidates(rarest), "candidates")
        docs = found.select("doc_id", "text_hash").distinct()
        docs = docs.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
        inside = self.postings.join(small(docs, docs.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi").distinct()
        wanted = found.join(small(every, every.count()), "window").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "window", "start", "length", F.col("term").alias("t"), (F.col("start") + F.col("offset")).alias("p"))
        met = wanted.join(inside, (F.col("h") == F.col("text_hash")) & (F.col("p") == F.col("pos")) & (F.col("t") == F.col("term")) & F.col("d").eqNullSafe(F.col("doc_id")))
        counted = met.groupBy("doc_id", "text_hash", "window", "start", "length").agg(F.count("*").alias("n"))
        return counted.where("n = length").drop("n")

    def proximity(self, windows: DataFrame, slop: int) -> DataFrame:
        """Places where the two rarest terms of a window stand in order with at most
        ``slop`` words more or less between them than in the window: doc_id,
        text_hash, window, first, second. Lists meet by blocks of positions."""
        rarest, _ = self.anchors(windows, 2)
        pairs = rarest.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("offset", "term"))).alias("p")).where(F.size("p") == 2)  # two a window
        pairs = pairs.select("window", F.col("p")[0].term.alias("t1"), F.col("p")[1].term.alias("t2"), (F.col("p")[1].offset - F.col("p")[0].offset).alias("gap"))
        pairs = small(pairs, pairs.count())
        block = lambda p: F.floor(p / (2 * slop + 1))
        first = self.postings.join(pairs, F.col("term") == F.col("t1")).select("doc_id", "text_hash", "window", F.col("pos").alias("first"), "gap")
        first = first.withColumn("block", F.explode(F.array_distinct(F.array(*[block(F.col("first") + F.col("gap") + d) for d in (-slop, slop)]))))
        second = self.postings.join(pairs, F.col("term") == F.col("t2")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("window").alias("w"), F.col("pos").alias("second"), block(F.col("pos")).alias("b"))
        near = (F.col("window") == F.col("w")) & (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("block") == F.col("b")) & (F.abs(F.col("second") - F.col("first") - F.col("gap")) <= slop) & (F.col("second") > F.col("first"))
        return first.join(second, near).select("doc_id", "text_hash", "window", "first", "second")


def contamination(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """One row for each (doc_id, text_hash) with a hit: n_hit words inside occurrences, item_ids (sorted strings)."""
    return indexed_contamination(df, benchmark, doc_id, text, item_id, item_text, size)[0]


def indexed_contamination(df: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, size: int) -> tuple[DataFrame, PositionalIndex]:
    windows = staged(benchmark_windows(benchmark, item_id, item_text, size), "windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    # windows of several items with the same words are looked up once
    looked_up = windows.select("words").distinct().withColumn("window", F.xxhash64("words"))
    index = PositionalIndex(df, vocabulary, doc_id, text)
    hits = staged(index.phrases(looked_up), "hits")
    items = windows.select("item_id", F.xxhash64("words").alias("w")).distinct()
    in_items = hits.join(small(items, items.count()), F.col("window") == F.col("w")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    words = hits.select("doc_id", "text_hash", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    words = words.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    return words.join(in_items, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select(F.col("d"), F.col("h"), "n_hit", "item_ids"), index


def contamination_report(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids for each row, from the index alone: the texts are read once."""
    found, index = indexed_contamination(df, benchmark, "doc_id", "text", "item_id", "text", WINDOW_WORDS)
    found = staged(found, "contamination")
    joined = index.lengths.join(small(found, found.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT p.rid, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.phrase = x.phrase AND p.n = x.n
), words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
