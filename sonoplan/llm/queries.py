"""Queries and oracle SQL of this subpackage, for the entry module."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .filteraudit import OP11_SQL, op11_filter_audit
from .images import op6_image_copies
from .infill import OP13_SQL, op13_fill_in_middle
from .jaccard import OP3_SQL, op3_jaccard
from .language import op7_language
from .lengths import op4_token_counts
from .linededup import OP8_SQL, op8_line_dedup
from .mixing import OP2_SQL, op2_mix
from .neighbors import OP12_SQL, op12_nearest
from .ngramlm import op5_lm_score
from .secrets import OP9_SQL, op9_secrets
from .substrings import OP1_SQL, op1_substrings

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_mix": op2_mix,
    "op3_jaccard": op3_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_lm_score": op5_lm_score,
    "op6_image_copies": op6_image_copies,
    "op7_language": op7_language,
    "op8_line_dedup": op8_line_dedup,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest": op12_nearest,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {
    "op1_substrings": OP1_SQL,
    "op3_jaccard": OP3_SQL,
    "op2_mix": OP2_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_secrets": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_nearest": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
