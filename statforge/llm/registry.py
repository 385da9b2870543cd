"""Queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from .bpe_codec import op12_bpe_codec
from .conversation_repair import OP11_SQL, op11_conversation_repair
from .minhash_dedup import OP3_SQL, op3_minhash_dedup
from .mixing import OP6_SQL, op6_mixing
from .packing import op9_packing
from .periodic_runs import op13_periodic_runs
from .quality_rules import OP4_SQL, op4_quality_rules
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op7_token_counts
from .token_output import op2_token_output
from .topk_search import OP10_SQL, op10_topk_search
from .toxicity import op8_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_output": op2_token_output,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_topk_search": op10_topk_search,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {
    "op3_minhash_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op10_topk_search": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
}
