"""The corpus operators as queries over the driver tables, and their SQL."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .extraction import op8_html
from .language import op2_language
from .mixing import op5_mixing
from .near_dedup import op4_near_dedup
from .pii import op3_pii
from .sql import OP3_SQL, OP4_SQL, OP7_SQL, OP9_SQL
from .substring import op9_substring
from .token_counts import op10_token_counts
from .topk import OP6_SQL, op6_topk
from .toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_language, op3_pii, op4_near_dedup, op5_mixing, op6_topk, op7_decontamination, op8_html, op9_substring, op10_token_counts)
}

#: Scores, fitted weights, tokenizers and page trees are beyond SQL; tests/llm compare those with brute force.
SQL = {"op3_pii": OP3_SQL, "op4_near_dedup": OP4_SQL, "op6_topk": OP6_SQL, "op7_decontamination": OP7_SQL, "op9_substring": OP9_SQL}
