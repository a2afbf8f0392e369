"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_parts
from .decontaminate import OP10_SQL, op10_winnowing
from .lexical_search import OP12_SQL, op12_block_max_wand
from .nbest import op3_nbest_astar
from .neighbours import op13_collision_counting
from .ngram_join import OP5_SQL, op5_size_aware_join
from .pii import op1_weak_supervision
from .quality_model import op7_random_indexing
from .quality_rules import OP8_SQL, op8_rule_ledger
from .resampling import op11_tournament_resampling
from .sharding import op9_virtual_slots
from .token_files import op6_seekable_tokens
from .unit_dedup import OP4_SQL, op4_unit_dedup

QUERIES = {
    "op1_weak_supervision": op1_weak_supervision,
    "op2_chat_parts": op2_chat_parts,
    "op3_nbest_astar": op3_nbest_astar,
    "op4_unit_dedup": op4_unit_dedup,
    "op5_size_aware_join": op5_size_aware_join,
    "op6_seekable_tokens": op6_seekable_tokens,
    "op7_random_indexing": op7_random_indexing,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_winnowing": op10_winnowing,
    "op11_tournament_resampling": op11_tournament_resampling,
    "op12_block_max_wand": op12_block_max_wand,
    "op13_collision_counting": op13_collision_counting,
}

ORACLE_SQL = {
    "op2_chat_parts": OP2_SQL,
    "op4_unit_dedup": OP4_SQL,
    "op5_size_aware_join": OP5_SQL,
    "op8_rule_ledger": OP8_SQL,
    "op10_winnowing": OP10_SQL,
    "op12_block_max_wand": OP12_SQL,
}
