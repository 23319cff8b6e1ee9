"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_collocations
from .fingerprints import op3_weighted_fingerprints
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_extract import op7_html_main_text
from .language_id import op5_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .media import op2_image_copies
from .mixing import op1_mix_sources
from .multi_index import op12_nearest_neighbours
from .packing import op8_pack_sequences
from .pii import op4_personal_data
from .simhash import op10_simhash_near_dedup
from .suffix_dedup import op9_suffix_dedup

_ALL = (
    op1_mix_sources, op2_image_copies, op3_weighted_fingerprints, op4_personal_data, op5_language_id, op6_line_dedup,
    op7_html_main_text, op8_pack_sequences, op9_suffix_dedup, op10_simhash_near_dedup,
    op11_hard_negatives, op12_nearest_neighbours, op13_collocations,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_collocations": OP13_SQL}
