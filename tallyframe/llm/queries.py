"""The registered queries of this package, each with its SQL where SQL can say the same."""

from __future__ import annotations

from tallyframe.llm.alignment import op12_galloping
from tallyframe.llm.brown import op1_brown_classes
from tallyframe.llm.decontaminate import OP9_SQL, op9_prefix_join
from tallyframe.llm.deobfuscate import op11_noisy_channel
from tallyframe.llm.isolation import op8_isolation_forest
from tallyframe.llm.licenses import op6_license_diagonals
from tallyframe.llm.minhash import OP5_SQL, op5_minhash_bayes
from tallyframe.llm.packing import op4_pack_nnls
from tallyframe.llm.ranking import OP13_SQL, op13_best_position
from tallyframe.llm.resampling import op7_importance_resampling
from tallyframe.llm.substrings import OP10_SQL, op10_induced_suffixes
from tallyframe.llm.token_files import op2_token_orc
from tallyframe.llm.trie import op3_trie_counts

QUERIES = {
    "op1_brown_classes": (op1_brown_classes, None),
    "op2_token_orc": (op2_token_orc, None),
    "op3_trie_counts": (op3_trie_counts, None),
    "op4_pack_nnls": (op4_pack_nnls, None),
    "op5_minhash_bayes": (op5_minhash_bayes, OP5_SQL),
    "op6_license_diagonals": (op6_license_diagonals, None),
    "op7_importance_resampling": (op7_importance_resampling, None),
    "op8_isolation_forest": (op8_isolation_forest, None),
    "op9_prefix_join": (op9_prefix_join, OP9_SQL),
    "op10_induced_suffixes": (op10_induced_suffixes, OP10_SQL),
    "op11_noisy_channel": (op11_noisy_channel, None),
    "op12_galloping": (op12_galloping, None),
    "op13_best_position": (op13_best_position, OP13_SQL),
}
