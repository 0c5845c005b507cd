"""The queries of this subpackage over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm.attribution import op8_section_tokens
from edgeloom.llm.byte_bpe import op9_byte_bpe
from edgeloom.llm.context_mixing import op2_context_mixing
from edgeloom.llm.licences import op7_licences
from edgeloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from edgeloom.llm.mixing import OP5_SQL, op5_mix_sources
from edgeloom.llm.periodic_runs import op13_periodic_runs
from edgeloom.llm.phrases import op11_phrase_fingerprints
from edgeloom.llm.pii import op1_personal_data
from edgeloom.llm.quality import OP3_SQL, op3_quality_rules
from edgeloom.llm.rp_forest import OP4_SQL, op4_nearest_vectors
from edgeloom.llm.simhash import op10_near_duplicates
from edgeloom.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_context_mixing": op2_context_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_mix_sources": op5_mix_sources,
    "op6_toxicity": op6_toxicity,
    "op7_licences": op7_licences,
    "op8_section_tokens": op8_section_tokens,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_phrase_fingerprints": op11_phrase_fingerprints,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": OP3_SQL,
    "op4_nearest_vectors": OP4_SQL,
    "op5_mix_sources": OP5_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
