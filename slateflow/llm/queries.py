"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, exact_dedup, fingerprint, html_text, line_dedup, lm_score, mixing, near_dedup, packing, pii, prefix_trie, quality, url_filter

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_lz_fingerprint": fingerprint.op4_lz_fingerprint,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_pii": pii.op6_pii,
    "op7_stupid_backoff": lm_score.op7_stupid_backoff,
    "op8_quality": quality.op8_quality,
    "op9_main_text": html_text.op9_main_text,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {**mixing.ORACLE, **exact_dedup.ORACLE, **url_filter.ORACLE, **lm_score.ORACLE, **line_dedup.ORACLE, **prefix_trie.ORACLE}
