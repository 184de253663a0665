"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, html_text, langid, mixing, ngram_join, packing, pieces, pii, quality, resampling, search, secrets, tokens

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_html_text": html_text.op2_html_text,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_language_id": langid.op6_language_id,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_pii": pii.op9_pii,
    "op10_packing": packing.op10_packing,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

SQL = {
    "op3_ngram_jaccard": ngram_join.OP3_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_ranked_search": search.OP12_SQL,
}
