"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, bpe, crf, divergence, jaccard, langid, lexical, licences, media, packing, repeats, topk, twins, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_language_id": langid.op2_language_id,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_host_reputation": urls.op4_host_reputation,
    "op5_substring_dedup": repeats.op5_substring_dedup,
    "op6_distribution_divergence": divergence.op6_distribution_divergence,
    "op7_quality_classifier": crf.op7_quality_classifier,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_media_columns": media.op10_media_columns,
    "op11_source_divergence_audit": audit.op11_source_divergence_audit,
    "op12_exact_top_k": topk.op12_exact_top_k,
    "op13_ranked_lexical_search": lexical.op13_ranked_lexical_search,
    "quality_base_counts": twins.quality_base_counts,
    "media_payloads": twins.media_payloads,
}
ORACLES = {
    "op1_ngram_jaccard_join": jaccard.ORACLE,
    "op4_host_reputation": urls.ORACLE,
    "op5_substring_dedup": repeats.ORACLE,
    "op11_source_divergence_audit": audit.ORACLE,
    "op12_exact_top_k": topk.ORACLE,
    "op13_ranked_lexical_search": lexical.ORACLE,
    "quality_base_counts": twins.BASE_SQL,
    "media_payloads": twins.PAYLOAD_SQL,
}
