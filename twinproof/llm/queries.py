"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from twinproof.llm import (
    centroid_clusters,
    decontamination,
    html_extract,
    langid,
    lm_scoring,
    mixing,
    pii,
    piece_encoding,
    quote_links,
    shingle_join,
    token_alignment,
    url_rules,
    vector_dedup,
)

QUERIES = {
    "op1_lm_score": lm_scoring.op1_lm_score,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_pseudonyms": pii.op4_pseudonyms,
    "op5_main_text": html_extract.op5_main_text,
    "op6_quote_links": quote_links.op6_quote_links,
    "op7_vector_dedup": vector_dedup.op7_vector_dedup,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_shingle_join": shingle_join.op9_shingle_join,
    "op10_language": langid.op10_language,
    "op11_alignment": token_alignment.op11_alignment,
    "op12_centroids": centroid_clusters.op12_centroids,
    "op13_pieces": piece_encoding.op13_pieces,
}

ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op8_url_rules": url_rules.OP8_SQL,
    "op12_centroids": centroid_clusters.OP12_SQL,
}
