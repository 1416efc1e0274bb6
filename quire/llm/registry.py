"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from quire.llm.jaccard import op2_jaccard_join
from quire.llm.language import op1_language
from quire.llm.lines import op9_line_dedup
from quire.llm.neighbours import op5_neighbours
from quire.llm.oracle import ORACLE
from quire.llm.packing import op3_harmonic_packing
from quire.llm.pieces import op8_pieces
from quire.llm.quality import op10_quality
from quire.llm.substrings import op4_substrings
from quire.llm.token_counts import op6_token_counts
from quire.llm.token_files import op7_token_files


def queries() -> dict[str, Callable]:
    found = [op1_language, op2_jaccard_join, op3_harmonic_packing, op4_substrings, op5_neighbours, op6_token_counts, op7_token_files, op8_pieces, op9_line_dedup, op10_quality]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
