"""Queries of the masks of low-complexity sequence. A turn of a conversation is a sequence: vowels are A, other letters C, spaces T, all else G."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators import masks as M
from haplospark.plans import analogues as X
from haplospark.plans.queries import query

KEYS = ["conv_id", "turn"]
#: Rounds that the SQL unrolls; the operators go on until nothing grows.
ROUNDS = 8


def _bases(spark, d) -> DataFrame:
    text = F.lower("text")
    for pattern, base in (("[aeiou]", "A"), ("[a-z]", "C"), (" ", "T"), ("[^ACT]", "G")):
        text = F.regexp_replace(text, pattern, base)
    return X.t(spark, d, "conversations").select(*KEYS, F.posexplode(F.split(text, "")).alias("i", "base")).where("base <> ''").select(*KEYS, (F.col("i") + 1).cast("long").alias("pos"), "base")


_SEQS = r"""seqs AS MATERIALIZED (SELECT conv_id, turn, s[:len(s) - 1] AS s FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[aeiou]', 'A', 'g'), '[a-z]', 'C', 'g'), ' ', 'T', 'g'), '(?s)[^ACT]', 'G', 'g') AS s FROM conversations)),
at AS MATERIALIZED (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS pos FROM seqs)""".replace("at AS", '"at" AS')
_GROWN = lambda name, distinct: ", ".join(
    f"""{name}{i} AS MATERIALIZED (SELECT * FROM {name}{i - 1} UNION ALL SELECT conv_id, turn, pos, {"arg_min(label, (first, label))" if distinct else "label"} FROM (
  SELECT DISTINCT c.conv_id, c.turn, unnest(range(first, last + 1)) AS pos, c.label, first FROM {name}_claims c JOIN {name}{i - 1} m ON m.conv_id = c.conv_id AND m.turn = c.turn AND m.pos = c.p AND {"m.label = c.label" if distinct else "m.label IN (c.label, reverse(c.label))"}) n
  WHERE NOT EXISTS (SELECT 1 FROM {name}{i - 1} k WHERE k.conv_id = n.conv_id AND k.turn = n.turn AND k.pos = n.pos{"" if distinct else " AND k.label = n.label"}) GROUP BY conv_id, turn, pos{"" if distinct else ", label"})"""
    for i in range(1, ROUNDS + 1)
)
_FIVE = " OR ".join(f"(pos > {k} AND substr(s, pos - {k}, 5) = repeat(s[pos], 5))" for k in range(5))
_HOMO = f"""h0 AS MATERIALIZED (SELECT conv_id, turn, pos, s[pos] AS label FROM "at" WHERE {_FIVE}),
h_claims AS MATERIALIZED (SELECT conv_id, turn, s[pos] AS label, pos + 1 + j AS p, pos - 3 AS first, pos + j AS last FROM "at", range(1, 5) r(j) WHERE pos > 3 AND substr(s, pos - 3, 4) = repeat(s[pos], 4) AND pos + j <= len(s) AND s[pos + 1] <> s[pos] AND substr(s, pos + 1, j) = repeat(s[pos + 1], j)
 UNION ALL SELECT conv_id, turn, s[pos], pos - 1 - j, pos - j, pos + 3 FROM "at", range(1, 5) r(j) WHERE substr(s, pos, 4) = repeat(s[pos], 4) AND pos - j >= 1 AND s[pos - 1] <> s[pos] AND substr(s, pos - j, j) = repeat(s[pos - 1], j)),
{_GROWN("h", True)}"""
_BRIDGE = "(j <= 1 OR (len(list_distinct(string_split(mid, ''))) = 2 AND (NOT (mid LIKE '%AA%' OR mid LIKE '%CC%' OR mid LIKE '%GG%' OR mid LIKE '%TT%') OR list_sort(list_distinct(string_split(mid, ''))) = list_sort(string_split(label, '')))))"
_PAIRED = f"""d0 AS MATERIALIZED (SELECT DISTINCT conv_id, turn, unnest(range(pos, pos + 8)) AS pos, substr(s, pos, 2) AS label FROM "at" WHERE pos + 7 <= len(s) AND substr(s, pos, 8) = repeat(substr(s, pos, 2), 4) AND s[pos] <> s[pos + 1]),
twice AS (SELECT *, substr(s, pos, 2) AS label FROM "at" WHERE pos + 3 <= len(s) AND substr(s, pos, 4) = repeat(substr(s, pos, 2), 2) AND s[pos] <> s[pos + 1]),
d_claims AS MATERIALIZED (SELECT conv_id, turn, label, pos + 4 + j AS p, pos AS first, pos + 3 + j AS last FROM (SELECT *, substr(s, pos + 4, j) AS mid FROM twice, range(0, 8) r(j) WHERE pos + 3 + j <= len(s)) WHERE {_BRIDGE}
 UNION ALL SELECT conv_id, turn, label, pos - 1 - j, pos - j, pos + 3 FROM (SELECT *, substr(s, pos - j, j) AS mid FROM twice, range(0, 8) r(j) WHERE pos - j >= 1) WHERE {_BRIDGE}),
{_GROWN("d", False)}"""


@query(f"SELECT * FROM h{ROUNDS}", (_SEQS, _HOMO))
def homopolymers(spark, d):
    return M.homopolymers(_bases(spark, d), KEYS)


@query(f"SELECT * FROM d{ROUNDS}", (_SEQS, _PAIRED))
def dinucleotides(spark, d):
    return M.dinucleotides(_bases(spark, d), KEYS)


_OWN = f"""told AS (SELECT m.*, EXISTS (SELECT 1 FROM h{ROUNDS} k WHERE k.conv_id = m.conv_id AND k.turn = m.turn AND k.pos = m.pos - 1) AS before, EXISTS (SELECT 1 FROM h{ROUNDS} k WHERE k.conv_id = m.conv_id AND k.turn = m.turn AND k.pos = m.pos + 1) AS after FROM h{ROUNDS} m),
said AS (SELECT conv_id, turn, pos, 1 AS rank, CASE WHEN after AND NOT before THEN 'A,C,G,T' ELSE label END AS mask FROM told UNION ALL SELECT conv_id, turn, pos + 1, 0, label || ',1' FROM told WHERE NOT after UNION ALL SELECT conv_id, turn, pos - 1, 2, label FROM told WHERE after AND NOT before),
homo AS (SELECT conv_id, turn, pos, arg_min(mask, rank) AS mask FROM said GROUP BY 1, 2, 3)"""


@query(f"""SELECT * FROM homo UNION ALL SELECT conv_id, turn, pos, string_agg(DISTINCT b, ',' ORDER BY b) FROM (SELECT conv_id, turn, pos, unnest(string_split(label, '')) AS b FROM d{ROUNDS}) p
 WHERE NOT EXISTS (SELECT 1 FROM homo h WHERE h.conv_id = p.conv_id AND h.turn = p.turn AND h.pos = p.pos) GROUP BY 1, 2, 3""", (_SEQS, _HOMO, _PAIRED, _OWN))  # fmt: skip
def sequence_masks(spark, d):
    return M.sequence_masks(_bases(spark, d), KEYS)
