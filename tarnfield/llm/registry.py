"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tarnfield.llm.decontamination import op9_decontamination
from tarnfield.llm.importance import op2_importance
from tarnfield.llm.pieces import op10_pieces
from tarnfield.llm.pii import op7_pii
from tarnfield.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from tarnfield.llm.quality_rules import op3_quality_rules
from tarnfield.llm.repeats import OP12_SQL, op12_repeats
from tarnfield.llm.resampling import OP11_SQL, op11_resampling
from tarnfield.llm.revisits import OP5_SQL, op5_revisits
from tarnfield.llm.secrets import op6_secrets
from tarnfield.llm.sharding import op4_sharding
from tarnfield.llm.simhash import op8_simhash
from tarnfield.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_importance": op2_importance,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_revisits": op5_revisits,
    "op6_secrets": op6_secrets,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_pieces": op10_pieces,
    "op11_resampling": op11_resampling,
    "op12_repeats": op12_repeats,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {"op5_revisits": OP5_SQL, "op11_resampling": OP11_SQL, "op12_repeats": OP12_SQL, "op13_prefix_trie": OP13_SQL}
