"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, codes, elkan, embed_dedup, langid, mixing, packing, pagediff, pii, simhash, substrings, urlfilter

QUERIES = {
    "op1_ann_posting_lists": ann.query,
    "op2_pii_candidate_boosting": pii.query,
    "op3_url_temporal_lists": urlfilter.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_embedding_near_dedup": embed_dedup.query,
    "op6_substring_de_bruijn": substrings.query,
    "op7_mix_sources": mixing.query,
    "op8_pack_sequences": packing.query,
    "op9_language_id": langid.query,
    "op10_chat_reply_trees": chat.query,
    "op11_html_page_differences": pagediff.query,
    "op12_centroid_elkan": elkan.query,
    "op13_vector_codes": codes.query,
}
ORACLES = {
    "op3_url_temporal_lists": urlfilter.ORACLE,
    "op5_embedding_near_dedup": embed_dedup.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op10_chat_reply_trees": chat.ORACLE,
    "op12_centroid_elkan": elkan.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
