"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quireworks.llm import bpe, divergence, fingerprint, language, manifest, mixing, neardup, pii, quality, repeats, tokenfile, topk, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe": bpe.op1_bpe,
    "op2_poisson_mix": mixing.op2_poisson_mix,
    "op3_language": language.op3_language,
    "op4_pii": pii.op4_pii,
    "op5_url_rules": url_filter.op5_url_rules,
    "op6_quality": quality.op6_quality,
    "op7_fingerprints": fingerprint.op7_fingerprints,
    "op8_topk": topk.op8_topk,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_long_repeats": repeats.op10_long_repeats,
    "op11_token_files": tokenfile.op11_token_files,
    "op12_divergence": divergence.op12_divergence,
    "op13_manifest": manifest.op13_manifest,
}
ORACLES = {
    "op2_poisson_mix": mixing.SQL,
    "op5_url_rules": url_filter.SQL,
    "op8_topk": topk.SQL,
    "op9_near_duplicates": neardup.SQL,
    "op12_divergence": divergence.SQL,
    "op13_manifest": manifest.SQL,
}
