"""The registered queries of the training-data operators and their checking SQL."""

from __future__ import annotations

from tickloom.llm import bpe, centroids, fmindex, langid, parity, phrases, pii, quality, sharding, simhash, suffixes, templates, variants

QUERIES = {
    "op1_fm_decontaminate": fmindex.query,
    "op2_phrase_automata": phrases.query,
    "op3_suffix_levels": suffixes.query,
    "op4_parity_join": parity.query,
    "op5_template_html": templates.query,
    "op6_byte_bpe": bpe.query,
    "op7_risk_rules": quality.query,
    "op8_hash_tree": sharding.query,
    "op9_bigru_language": langid.query,
    "op10_pii_anchors": pii.query,
    "op11_spelling_variants": variants.query,
    "op12_simhash_pivots": simhash.query,
    "op13_shallot_clusters": centroids.query,
}
ORACLE: dict[str, str] = {
    "op1_fm_decontaminate": fmindex.SQL, "op4_parity_join": parity.SQL, "op2_phrase_automata": phrases.SQL, "op3_suffix_levels": suffixes.SQL,
    "op11_spelling_variants": variants.SQL, "op12_simhash_pivots": simhash.SQL, "op13_shallot_clusters": centroids.SQL,
}
