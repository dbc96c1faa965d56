"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op5_nearest_neighbours
from .chat import op6_chat_formatting
from .jaccard import op10_ngram_jaccard_join
from .packing import op8_best_fit_packing
from .pieces import op7_sentencepiece
from .pii import op3_personal_data
from .quality import op9_quality_classifier
from .records import op1_token_records
from .substrings import op4_substring_dedup
from .topk import OP2_SQL, op2_exact_topk

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_exact_topk": op2_exact_topk,
    "op3_personal_data": op3_personal_data,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {"op2_exact_topk": OP2_SQL}
