"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import op1_mixing, op2_token_output, op3_secrets, op4_jaccard_join, op5_quality, op6_decontaminate, op7_language, op8_cotraining, op9_token_counts, op10_license, op11_spelling_variants, op12_fill_in_middle, op13_lattice_score

_MODULES = [op1_mixing, op2_token_output, op3_secrets, op4_jaccard_join, op5_quality, op6_decontaminate, op7_language, op8_cotraining, op9_token_counts, op10_license, op11_spelling_variants, op12_fill_in_middle, op13_lattice_score]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
