"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import op9_chat_template
from .counts import op13_token_counts
from .embdup import op5_cross_polytope
from .langid import op10_ngram_ftrl
from .minhash import op8_minhash_bayes
from .mix import op4_mix_blocks
from .pieces import op7_viterbi_pieces
from .quality import op2_discriminant, op3_tree_rules
from .shard import op6_hash_tree
from .spelling import op11_spelling_variants
from .tokens import op1_token_blocks
from .vqcodes import codebook_sql, op12_segment_bounds

QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_discriminant": op2_discriminant,
    "op3_tree_rules": op3_tree_rules,
    "op4_mix_blocks": op4_mix_blocks,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_hash_tree": op6_hash_tree,
    "op7_viterbi_pieces": op7_viterbi_pieces,
    "op8_minhash_bayes": op8_minhash_bayes,
    "op9_chat_template": op9_chat_template,
    "op10_ngram_ftrl": op10_ngram_ftrl,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_segment_bounds": op12_segment_bounds,
    "op13_token_counts": op13_token_counts,
}
ORACLE_SQL: dict[str, str] = {"op12_segment_bounds": codebook_sql()}
