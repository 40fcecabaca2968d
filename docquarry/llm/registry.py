"""The queries of this package and, where SQL can say the same, their SQL."""

from .alignment import op13_alignment
from .decontaminate import op8_decontamination
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language import op7_language
from .line_dedup import OP5_SQL, op5_line_dedup
from .near_dedup import op4_near_dedup
from .neighbours import op10_neighbours
from .packing import op2_packing
from .personal_data import op9_personal_data
from .secret_scan import OP12_SQL, op12_secrets
from .substrings import op6_substrings
from .token_counts import op3_token_counts
from .token_files import op1_token_files

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_substrings": op6_substrings,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_neighbours": op10_neighbours,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secrets": op12_secrets,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_secrets": OP12_SQL}
