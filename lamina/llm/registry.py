"""Queries of the text operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, chat, fingerprint, hnsw, html, jaccard, language, merkle, negatives, ngrams, packing, tokencount, toxicity

QUERIES = {
    "op1_imatch": fingerprint.op1_imatch,
    "op2_chat_format": chat.op2_chat_format,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_nearest_neighbours": hnsw.op4_nearest_neighbours,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_language_id": language.op7_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_lm_scores": ngrams.op13_lm_scores,
}

#: The others learn, approximate, or follow a tokenizer: the tests hold them against brute force, libraries and held-out labels.
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat.OP2_SQL, "op5_ngram_jaccard": jaccard.OP5_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
