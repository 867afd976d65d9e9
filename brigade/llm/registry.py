"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import alignment, exact_dedup, kneser_ney, licences, ngram_join, packing, pieces, pii, quality, token_count, topk, training_order, whitening

QUERIES = {
    "op1_pii_pseudonyms": pii.query,
    "op2_sentence_pieces": pieces.query,
    "op3_token_counts": token_count.query,
    "op4_kneser_ney_scores": kneser_ney.query,
    "op5_exact_top_k": topk.query,
    "op6_training_order": training_order.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_packing": packing.query,
    "op10_quality_classifier": quality.query,
    "op11_embedding_whitening": whitening.query,
    "op12_license_scans": licences.query,
    "op13_tokenizer_alignment": alignment.query,
}

ORACLES: dict[str, str] = {
    "op5_exact_top_k": topk.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
}
