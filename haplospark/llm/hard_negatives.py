"""Hard negatives by distributed radix selection.

The rows that an anchor looks for are the first k of a window: those of its own
label (its positives), or those of other labels whose score lies in a range set
by a positive's score. Scores are integer inner products, higher ones first,
ties by the smaller id.

Selection never sorts a window. A pass counts, for each window, its rows by one
digit (8 bits) of the score's distance from the window's upper end; running
sums find the digit that holds the k-th row, and the next pass refines that one
digit. Where all digits of the score are fixed and too many rows share it, the
digits of the id are refined the same way. As soon as a window has at most
``GATHER`` rows up to the end of its digit, its cut is known, and one last pass
gathers only the rows before the cut; equal (score, id) are gathered as one
with a count, so copies cannot fill a window.

A pass multiplies matrices: all rows stand in blocks of some thousand vectors,
anchors in blocks as well, and each pair of blocks is one task's step. Pairs
are spread by block, so no label or vector can be hot; what a task sends is
counted first.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; a null id comes last among ties and is no anchor; rows
of equal id are rows of their own, an anchor's copies among its positives; of
vectors of different length the shorter one counts as ended by zeros;
components beyond 2^26 after scaling count as 2^26; a window without rows gives
none, as does an empty table; other columns aren't read, whatever their names.
Ids span less than 2^63.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.llm.common import bound_batches, drop_staged, give_back, staged, table
from haplospark.llm.vectors import BOUND, SCALE, blocks, matrix, unpacked, usable

DIGIT_BITS = 8
#: A window with no more rows up to the end of its digit is gathered.
GATHER = 64
#: Anchors of a block, about.
ANCHOR_ROWS = 2048
#: After all ids.
LAST = (1 << 63) - 1
#: An anchor's windows; scores of lo to hi (of ``score`` alone, once it is fixed: then lo to hi are ids), counted by digits from ``shift`` on.
#: Rows before the cut (cut_score, cut_id) are the ones to gather, once it is known.
WINDOW = "slot int, top long, lo long, hi long, shift int, above long, score long, cut_score long, cut_id long"
NAMES = [c.split()[0] for c in WINDOW.split(", ")]


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their whole numbers, else in integers."""
    longest = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    if longest(a) * longest(x) < 1 << 52:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


class Anchors:
    """A block of anchors and their windows, as arrays: an absent window has a range without scores."""

    def __init__(self, packed: pa.StructArray):
        field = lambda a, c: a.field(c).to_numpy(zero_copy_only=False)
        self.keys, self.tags = field(packed, "anchor"), field(packed, "tag")
        vectors = packed.field("vector")
        self.x = matrix(vectors, int(np.diff(vectors.offsets.to_numpy()).max(initial=0)))
        lists = packed.field("windows")
        windows, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.slots = int(field(windows, "slot").max(initial=-1)) + 1
        self.of = {c: np.zeros((self.slots, len(sizes)), np.int64) for c in NAMES}
        self.of["lo"] += LAST
        self.of["hi"] -= LAST
        self.of["top"] -= LAST
        self.fixed, self.cut = (np.zeros((self.slots, len(sizes)), bool) for _ in range(2))
        at = (field(windows, "slot"), owner)
        for c in NAMES:
            self.of[c][at] = windows.field(c).fill_null(0).to_numpy(zero_copy_only=False)
        self.fixed[at], self.cut[at] = (windows.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("score", "cut_score"))


def histograms(a: Anchors, ai: np.ndarray, score: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Anchor, slot, digit and number of the rows of each open window, from candidate pairs (anchor, row)."""
    counted = []
    for slot in range(a.slots):
        of = {c: v[slot][ai] for c, v in a.of.items()}
        place = np.where(a.fixed[slot][ai], ids, -score)  # ascending in the order of selection
        lo, hi = np.where(a.fixed[slot][ai], of["lo"], -of["hi"]), np.where(a.fixed[slot][ai], of["hi"], -of["lo"])
        hit = (place >= lo) & (place <= hi) & (~a.fixed[slot][ai] | (score == of["score"])) & ~a.cut[slot][ai]
        digit = (place[hit].astype(np.uint64) - lo[hit].astype(np.uint64)) >> of["shift"][hit].astype(np.uint64)
        flat, n = np.unique(ai[hit] << DIGIT_BITS | digit.astype(np.int64), return_counts=True)
        counted.append((a.keys[flat >> DIGIT_BITS], np.full(len(flat), slot, np.int32), (flat & ((1 << DIGIT_BITS) - 1)).astype(np.int32), n))
    return [np.concatenate(c) for c in zip(*counted)] if counted else [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]


def gathered(a: Anchors, ai: np.ndarray, score: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Anchor, slot, score, id and number of the rows before each window's cut."""
    found = []
    for slot in range(a.slots):
        of = {c: v[slot][ai] for c, v in a.of.items()}
        hit = a.cut[slot][ai] & (score <= of["top"]) & ((score > of["cut_score"]) | ((score == of["cut_score"]) & (ids <= of["cut_id"])))
        key = np.stack([ai[hit], score[hit], ids[hit]], axis=1)
        one, n = np.unique(key, axis=0, return_counts=True) if len(key) else (key, np.zeros(0, np.int64))
        found.append((a.keys[one[:, 0]], np.full(len(one), slot, np.int32), one[:, 1], one[:, 2], n))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64)]


def _pass(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, null_id: int, count: Callable, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors that have windows: both are dealt by (anchor block, salt), a row block to one salt of each
    anchor block, anchors to all."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = anchors.join(windows.groupBy("anchor").agg(F.collect_list(F.struct(*NAMES)).alias("windows")), "anchor")
    n = max(1, -(-anchors.count() // ANCHOR_ROWS))
    salts = max(1, -(-tasks // n))
    packs = held.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n)).alias("pack")).agg(F.collect_list(F.struct("anchor", "tag", "vector", "windows")).alias("anchors"))
    left = rows.select("*", F.pmod(F.xxhash64("ids", "vectors"), F.lit(salts)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pack"))
    right = packs.select("pack", "anchors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = left.repartition(tasks, "pack", "salt").join(right.repartition(tasks, "pack", "salt").hint("shuffle_hash"), ["pack", "salt"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.fill_null(null_id).to_numpy(zero_copy_only=False)
                tags = batch.column("tags")[i].values.to_numpy(zero_copy_only=False)
                x, a = unpacked(batch.column("vectors")[i].as_py(), len(ids)), Anchors(batch.column("anchors")[i].values)
                open_lo = np.where(a.cut, a.of["cut_score"], np.where(a.fixed, a.of["score"], a.of["lo"])).min(axis=0)
                for start in range(0, len(a.keys), 256):
                    part = slice(start, start + 256)
                    score = products(a.x[part], x[:, : a.x.shape[1]])  # beyond its width an anchor is zero
                    wanted = (score >= open_lo[part, None]) & (score <= a.of["top"].max(axis=0)[part, None]) & ((a.tags[part, None] == tags) == same)
                    ai, ri = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in count(a, ai + start, score[ai, ri], ids[ri])], names=names)
            give_back()

    bound_batches(spark)
    return pairs.select("ids", "tags", "vectors", "anchors").mapInArrow(run, schema)


def _bits(span: Column) -> Column:
    """Bits of a whole number of 0 or more."""
    return F.length(F.regexp_replace(F.bin(span), "^0+", ""))


def _shift(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0), _bits(hi - lo) - DIGIT_BITS)


def _without_self(windows: DataFrame, anchors: DataFrame, keep: Column, what: list[Column]) -> DataFrame:
    """A row of -1 for each window whose own anchor stands in it."""
    own = windows.join(anchors.select("anchor", F.col("id").alias("own_id"), F.col("own").alias("own_score")), "anchor")
    return own.where(keep).select("anchor", "slot", *what, F.lit(-1).cast("long").alias("n"))


def first_of_windows(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, k: int, ids: tuple[int, int]) -> DataFrame:
    """windows(anchor, slot, lo, hi) of scores -> anchor, slot, rank, id, score: the first k rows of each window. ``ids``: the least id, and
    the number that stands for a null one, above all others."""
    null_id = ids[1]
    fresh = {"top": F.col("hi"), "shift": _shift(F.col("lo"), F.col("hi")), "above": F.lit(0).cast("long"), **{c: F.lit(None).cast("long") for c in ("score", "cut_score", "cut_id")}}
    now = staged(windows.where("lo <= hi").select("anchor", "slot", "lo", "hi").withColumns(fresh).select("anchor", *NAMES), "windows")
    by, done, written = ["anchor", "slot"], [], [now]
    while now.count():
        counts = _pass(rows, anchors, now, same, ids[1], histograms, "anchor long, slot int, digit int, n long")
        if same:
            place = F.when(F.col("score").isNull(), F.col("hi") - F.col("own_score")).otherwise(F.col("own_id") - F.col("lo"))
            inside = F.when(F.col("score").isNull(), F.col("own_score").between(F.col("lo"), F.col("hi"))).otherwise((F.col("own_score") == F.col("score")) & F.col("own_id").between(F.col("lo"), F.col("hi")))
            counts = counts.unionByName(_without_self(now, anchors, inside, [F.call_function("shiftright", place, F.col("shift")).cast("int").alias("digit")]))
        summed = counts.groupBy(*by, "digit").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("digit")))
        with_need = summed.join(now.select(*by, (F.lit(k) - F.col("above")).alias("need")), by)
        kth = with_need.where("upto >= need").groupBy(*by).agg(F.min(F.struct("digit", "upto", "n")).alias("at")).select(*by, F.col("at.digit").alias("digit"), F.col("at.upto").alias("upto"), F.col("at.n").alias("here"))
        x = now.join(kth, by, "left")
        by_id, width = F.col("score").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift")) - 1
        start = F.call_function("shiftleft", F.col("digit").cast("long"), F.col("shift"))
        lo = F.when(by_id, F.col("lo") + start).otherwise(F.greatest(F.col("lo"), F.col("hi") - start - width))
        hi = F.when(by_id, F.least(F.col("hi"), F.col("lo") + start + width)).otherwise(F.col("hi") - start)
        x = x.select(*by, "top", "digit", F.when(F.col("digit").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("digit").isNull(), F.col("hi")).otherwise(hi).alias("hi"), (F.col("above") + F.coalesce(F.col("upto") - F.col("here"), F.lit(0))).alias("above"), (F.col("above") + F.col("upto")).alias("through"), "score")
        by_id = F.col("score").isNotNull()
        few = F.col("digit").isNull() | (F.col("through") <= GATHER) | (by_id & (F.col("lo") == F.col("hi")))
        cut = x.select(*by, "top", "lo", "hi", F.lit(0).alias("shift"), "above", "score", F.when(few, F.coalesce("score", "lo")).alias("cut_score"), F.when(few, F.when(by_id, F.col("hi")).otherwise(F.lit(LAST))).alias("cut_id"))
        ends = F.col("score").isNull() & (F.col("lo") == F.col("hi")) & F.col("cut_score").isNull()  # one score alone is left: ids decide
        step = cut.select(*by, "top", F.when(ends, F.lit(ids[0])).otherwise(F.col("lo")).alias("lo"), F.when(ends, F.lit(ids[1])).otherwise(F.col("hi")).alias("hi"), "above", F.when(ends, F.col("lo")).otherwise(F.col("score")).alias("score"), "cut_score", "cut_id")
        step = staged(step.withColumn("shift", _shift(F.col("lo"), F.col("hi"))).select("anchor", *NAMES), "windows")
        done.append(step.where("cut_score IS NOT NULL"))
        written.append(step)
        now = step.where("cut_score IS NULL")
    if not done:
        return rows.sparkSession.createDataFrame([], "anchor long, slot int, rank int, id long, score long")
    cuts = done[0]
    for more in done[1:]:
        cuts = cuts.unionByName(more)
    found = _pass(rows, anchors, cuts, same, ids[1], gathered, "anchor long, slot int, score long, id long, n long")
    if same:
        before = (F.col("own_score") <= F.col("top")) & ((F.col("own_score") > F.col("cut_score")) | ((F.col("own_score") == F.col("cut_score")) & (F.col("own_id") <= F.col("cut_id"))))
        own = _without_self(cuts.drop("score"), anchors, before, [F.col("own_score").alias("score"), F.col("own_id").alias("id")])
        found = found.unionByName(own.select("anchor", "slot", "score", "id", "n"))
    each = found.groupBy(*by, "score", "id").agg(F.sum("n").alias("n")).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    ranked = each.withColumn("upto", upto).where(F.col("upto") - F.col("n") < k)
    ranks = F.sequence((F.col("upto") - F.col("n") + 1).cast("int"), F.least(F.col("upto"), F.lit(k)).cast("int"))
    out = staged(ranked.select(*by, F.explode(ranks).alias("rank"), F.when(F.col("id") != null_id, F.col("id")).alias("id"), "score"), "selected")
    for table_ in written:
        drop_staged(table_)
    return out


def mine(df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100) -> DataFrame:
    """-> anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's first positives, the first rows of another
    label whose score is ``least_percent`` to ``most_percent`` of the positive's. ``is_anchor``: which rows are anchors; ``label``: a column or an expression of one."""
    label = F.col(label) if isinstance(label, str) else label
    kept = df.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("tag"), F.col(vector).alias("vector"), is_anchor.alias("anchors")).where(F.col("tag").isNotNull() & usable(F.col("vector")))
    facts = kept.agg(F.max(F.size("vector")).alias("width"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if facts["width"] is None or facts["low"] is None:
        return df.sparkSession.createDataFrame([], schema)
    ids = (facts["low"], facts["high"] + 1)
    rows = staged(blocks(kept, F.col("id"), F.col("tag"), F.col("vector"), max(1, facts["width"])), "rows")
    whole = F.transform(F.col("vector").cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(BOUND)), F.lit(-BOUND)).cast("long"))
    own = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    anchors = kept.where("anchors").select(F.monotonically_increasing_id().alias("anchor"), "id", "tag", whole.alias("vector"))
    anchors = staged(anchors.withColumn("own", own), "anchors")
    longest = kept.select(whole.alias("vector")).agg(F.max(own)).first()[0]
    reach = (F.ceil(F.sqrt(F.col("own").cast("double")) * float(longest) ** 0.5) + 1).cast("long")
    pos = first_of_windows(rows, anchors, anchors.select("anchor", F.lit(0).alias("slot"), (-reach).alias("lo"), reach.alias("hi")), True, positives, ids)
    pos = pos.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    up = lambda share: F.expr(f"CAST(-floor(-positive_score * {share}BD / 100BD) AS long)")
    down = F.expr(f"CAST(floor(positive_score * {most_percent}BD / 100BD) AS long)")
    neg = first_of_windows(rows, anchors, pos.select("anchor", "slot", up(least_percent).alias("lo"), down.alias("hi")), False, negatives, ids)
    found = neg.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pos, ["anchor", "slot"])
    out = found.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(*(c.split()[0] for c in schema.split(", ")))
    drop_staged(rows)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), label=label)


OP12_SQL = """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a, v WHERE a.vec_id % 100 = 0 AND a.r <> v.r
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor, anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
