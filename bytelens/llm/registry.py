"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from . import decontaminate, html, language, licenses, mixing, scoring, sharding, simhash, suffix, topk

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        simhash.op2_simhash_components,
        topk.op3_top_k,
        decontaminate.op4_decontaminate,
        html.op5_html_text,
        suffix.op6_suffix_dedup,
        licenses.op7_licence_scan,
        language.op8_language_id,
        scoring.op9_lm_scores,
        sharding.op10_stratified_shards,
    )
}
ORACLES = {**topk.ORACLE, **decontaminate.ORACLE, **suffix.ORACLE, **licenses.ORACLE}
