"""The queries of this folder and their SQL, by name."""

from lakequill.llm import bpe, exact_dedup, language_id, licenses, lm_scoring, manifest, mixing, near_dedup, prefix_trie, secrets, substring_dedup, token_counts, topk_search

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_licenses": licenses.op6_licenses,
    "op7_secrets": secrets.op7_secrets,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_manifest": manifest.op13_manifest,
}

SQL = {"op2_topk_search": topk_search.OP2_SQL, "op3_mixing": mixing.OP3_SQL, "op6_licenses": licenses.OP6_SQL, "op8_substring_dedup": substring_dedup.OP8_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op13_manifest": manifest.OP13_SQL}
