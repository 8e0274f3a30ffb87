"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .decontaminate import op3_decontaminate
from .language_id import op13_language_id
from .lexical import ORACLE as LEXICAL
from .lexical import op12_lexical
from .licenses import op8_license_scan
from .line_dedup import ORACLE as LINE_DEDUP
from .line_dedup import op9_line_dedup
from .lm_score import op7_lm_score
from .near_dup import op5_near_dup
from .neighbours import op1_neighbours
from .prefix_trie import ORACLE as PREFIX_TRIE
from .prefix_trie import op11_prefix_trie
from .quality import op2_quality
from .substring_dedup import ORACLE as SUBSTRING_DEDUP
from .substring_dedup import op4_substring_dedup
from .token_shards import op6_token_shards

QUERIES = {f.__name__: f for f in (op1_neighbours, op2_quality, op3_decontaminate, op4_substring_dedup, op5_near_dup, op6_token_shards, op7_lm_score, op8_license_scan, op9_line_dedup, op10_byte_bpe, op11_prefix_trie, op12_lexical, op13_language_id)}
ORACLES: dict[str, str] = {"op4_substring_dedup": SUBSTRING_DEDUP, "op9_line_dedup": LINE_DEDUP, "op11_prefix_trie": PREFIX_TRIE, "op12_lexical": LEXICAL}
