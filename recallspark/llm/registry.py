"""Queries of the training-data operators, by the numbers they were dealt."""

from __future__ import annotations

from . import brown, divergence, exact_dedup, fingerprint, language, licenses, merkle, mixing, near_dedup, packing, pii, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_sum_of_squares_packing": packing.op2_sum_of_squares_packing,
    "op3_weighted_fingerprints": fingerprint.op3_weighted_fingerprints,
    "op4_language_id": language.op4_language_id,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_brown_lm": brown.op12_brown_lm,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op5_source_mix": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
