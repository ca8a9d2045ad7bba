"""Queries and SQL of this package, for the registry."""

from __future__ import annotations

import corpus_pipeline
from clonoscope.llm import alignment, audio, divergence, fingerprint, jaccard, license, line_dedup, lm, minhash, mixing, packing, secrets, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_license_scans": license.op3_license_scans,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_media_columns": audio.op9_media_columns,
    "op10_document_fingerprints": fingerprint.op10_document_fingerprints,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_minhash_dedup": minhash.op12_minhash_dedup,
    "op13_token_alignment": alignment.op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op6_ngram_jaccard_join": jaccard.SQL,
    "op8_secret_scans": secrets.SQL,
    "op10_document_fingerprints": fingerprint.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_minhash_dedup": minhash.SQL,
}
