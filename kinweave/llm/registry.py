"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import audio, compression, language, mixing, packing, rules, secrets, simhash, toxicity, urls

QUERIES = (
    simhash.op1_simhash_near_dedup,
    audio.op2_chroma_fingerprints,
    secrets.op3_secret_scans,
    toxicity.op4_toxicity_segments,
    rules.op5_quality_rules,
    language.op6_language_crf,
    packing.op7_vector_packing,
    mixing.op8_mix_sources,
    compression.op9_quality_compression,
    urls.op10_url_filters,
)
ORACLES = {"op3_secret_scans": secrets.ORACLE_SQL, "op8_mix_sources": mixing.ORACLE_SQL, "op5_quality_rules": rules.ORACLE_SQL, "op10_url_filters": urls.ORACLE_SQL}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
