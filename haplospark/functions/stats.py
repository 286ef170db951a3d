"""Column functions for copy numbers and thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth_posterior(reads: Column, haploid_depth: Column, most: int = 4) -> Column:
    """array of P(copy number = 1..most | reads), Poisson with a flat prior. The factorial and the
    power of the depth cancel, so logarithms of small numbers suffice, and far from every copy number there is still an
    answer, where densities that underflow would leave none. Null without depth, if reads were seen."""
    logs = [reads * F.log(F.lit(float(i))) - i * haploid_depth for i in range(1, most + 1)]
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    total = sum(weights[1:], weights[0])
    return F.when((haploid_depth > 0) | (reads == 0), F.array(*[w / total for w in weights]))


def edge_threshold(counts: Column) -> Column:
    """How few reads make an edge weak: from the least count above the overall least."""
    rest = F.filter(counts, lambda c: c > F.array_min(counts))
    m = F.array_min(rest)
    return F.when(m > 10, F.least(F.lit(5), F.greatest(F.lit(2), F.floor(m / 25).cast("int")))).when(m > 5, 1).otherwise(0)


def sex_of(x: Column, y: Column) -> Column:
    """From median depths on X and Y; null if undecided."""
    ratio = y / x
    return F.when(x == 0, None).when(ratio < 0.05, "female").when(ratio > 0.1, F.when(x > 1.95 * y, "female").otherwise("male"))
