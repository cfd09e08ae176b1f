"""Registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from ledgerlark.llm import divergence, ibf, langid, linededup, media, mixing, mixlm, packing, secrets, simhash, survival, toxicity, urlfilter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_media": media.op5_media,
    "op6_packing": packing.op6_packing,
    "op7_fingerprints": ibf.op7_fingerprints,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_language": langid.op9_language,
    "op10_context_mixing": mixlm.op10_context_mixing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_filter_audit": survival.op13_filter_audit,
}

ORACLES = {
    "op3_line_dedup": linededup.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_filter_audit": survival.ORACLE,
}
