"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .collocations import OP12_SQL, op12_collocations
from .decontaminate import OP6_SQL, op6_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .fingerprints import op11_fingerprints
from .mixing import OP9_SQL, op9_mixing
from .near_dedup import OP7_SQL, op7_near_dedup
from .pii import op8_pii
from .quality import op4_quality
from .suffix_dedup import op2_suffix_dedup
from .token_output import op3_token_output
from .toxicity import op5_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_output": op3_token_output,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op6_decontaminate": OP6_SQL, "op7_near_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op12_collocations": OP12_SQL}
