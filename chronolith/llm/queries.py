"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from chronolith.llm import chat, codes, crf, language, lcp, mixing, negatives, packing, pii, sentences, simhash, toxicity, urls

QUERIES = {
    "op7_sentences": sentences.query,
    "op3_mixing": mixing.query,
    "op10_pii": pii.query,
    "op2_chat": chat.query,
    "op6_toxicity": toxicity.query,
    "op8_language": language.query,
    "op4_quality": crf.query,
    "op1_fingerprint": lcp.query,
    "op9_packing": packing.query,
    "op5_simhash": simhash.query,
    "op11_url_filter": urls.query,
    "op12_hard_negatives": negatives.query,
    "op13_vector_codes": codes.query,
}

ORACLES: dict[str, str] = {
    "op2_chat": chat.SQL,
    "op11_url_filter": urls.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_vector_codes": codes.SQL,
}
