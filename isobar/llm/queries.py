"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .decontaminate import op10_decontaminate
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .language_id import op1_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .packing import op6_packing
from .quality import op5_quality
from .sharding import op4_sharding
from .simhash import op7_simhash
from .substring_dedup import op9_substring_dedup
from .token_files import op8_token_files

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_token_files": op8_token_files,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontaminate": op10_decontaminate,
}

SQL = {"op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL}
