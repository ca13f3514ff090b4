"""Operators for building training corpora; nothing else in the package imports this one.

``QUERIES`` and ``ORACLES`` are what the entry point registers when this subpackage is present.
"""

from __future__ import annotations

from .ann import op7_ann
from .bpe import op3_bpe
from .chat import op2_chat
from .exact_dedup import op9_exact_dedup, op9_sql
from .mixing import op8_mixing, op8_sql
from .simhash import op6_simhash
from .quality import op5_quality
from .sharding import op4_sharding, op4_sql
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat": op2_chat,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_ann": op7_ann,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {"op4_sharding": op4_sql, "op8_mixing": op8_sql, "op9_exact_dedup": op9_sql}
