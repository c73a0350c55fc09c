"""Queries and SQL of this folder, by name."""
from __future__ import annotations

from .bitsliced import OP2_SQL, op2_bitsliced_topk
from .curve_packing import op13_curve_packing
from .decontaminate import OP3_SQL, op3_decontaminate
from .maxscore import OP12_SQL, op12_ranked_search
from .neardup import op4_minhash_near_dedup
from .repeats import OP5_SQL, op5_substring_dedup
from .sharding import OP1_SQL, op1_shard_interleave
from .suffixes import op8_suffix_dedup
from .token_counts import op6_token_counts
from .tokenizer import op10_bpe
from .toxicity import op9_toxicity
from .turns import OP11_SQL, op11_turn_repair
from .wrapper import op7_wrapper_text

QUERIES = {
    "op1_shard_interleave": op1_shard_interleave,
    "op2_bitsliced_topk": op2_bitsliced_topk,
    "op3_decontaminate": op3_decontaminate,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_wrapper_text": op7_wrapper_text,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_turn_repair": op11_turn_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_curve_packing": op13_curve_packing,
}
SQL = {"op2_bitsliced_topk": OP2_SQL, "op1_shard_interleave": OP1_SQL, "op3_decontaminate": OP3_SQL, "op5_substring_dedup": OP5_SQL,
       "op11_turn_repair": OP11_SQL, "op12_ranked_search": OP12_SQL}
