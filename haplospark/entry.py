"""Queries of the reference's operators and their SQL."""

from __future__ import annotations

from haplospark.plans import blocks, calls, encoding, events, fusions, hap_rows, links, masks, sites  # noqa: F401
from haplospark.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "depth_summary_p80"
