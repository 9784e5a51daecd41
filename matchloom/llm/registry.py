"""The subpackage's queries by name, and the SQL that some of them must agree with."""

from __future__ import annotations

from matchloom.llm.chat import OP2_SQL, op2_chat
from matchloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from matchloom.llm.near_dedup import op8_near_dedup
from matchloom.llm.packing import op4_best_fit_packing
from matchloom.llm.page_text import op9_page_text
from matchloom.llm.piece_codec import op6_piece_codec
from matchloom.llm.sharding import op11_sharding
from matchloom.llm.substring_dedup import op7_substring_dedup
from matchloom.llm.token_counts import op10_token_counts
from matchloom.llm.topk import OP3_SQL, op3_top_k
from matchloom.llm.toxicity import op5_toxicity
from matchloom.llm.vector_codes import OP13_SQL, op13_vector_codes
from matchloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat": op2_chat,
    "op3_top_k": op3_top_k,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_piece_codec": op6_piece_codec,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_page_text": op9_page_text,
    "op10_token_counts": op10_token_counts,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op2_chat": OP2_SQL,
    "op3_top_k": OP3_SQL,
    "op13_vector_codes": OP13_SQL,
}
