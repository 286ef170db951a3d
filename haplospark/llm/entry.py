"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from haplospark.llm.centroids import OP13_SQL, op13_exponion_clusters
from haplospark.llm.decontaminate import OP4_SQL, op4_decontamination
from haplospark.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from haplospark.llm.language_model import op3_language_model
from haplospark.llm.link_graph import op7_link_graph
from haplospark.llm.mixing import OP2_SQL, op2_source_mix
from haplospark.llm.near_dedup import op5_near_dedup
from haplospark.llm.pieces import op11_pieces
from haplospark.llm.pu_quality import op6_pu_quality
from haplospark.llm.quality_rules import op1_quality_rules
from haplospark.llm.surrogates import op10_surrogates
from haplospark.llm.token_files import op8_token_files
from haplospark.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_language_model": op3_language_model,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_pu_quality": op6_pu_quality,
    "op7_link_graph": op7_link_graph,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_surrogates": op10_surrogates,
    "op11_pieces": op11_pieces,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exponion_clusters": op13_exponion_clusters,
}

ORACLE_SQL: dict[str, str] = {"op2_source_mix": OP2_SQL, "op4_decontamination": OP4_SQL, "op12_hard_negatives": OP12_SQL, "op13_exponion_clusters": OP13_SQL}
