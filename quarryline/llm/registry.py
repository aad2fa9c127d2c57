"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_galloping_alignment
from .decontaminate import op2_seeded_alignment
from .fixity import OP8_SQL, op8_merkle_fixity
from .language import op5_hyperdimensional_language
from .packing import op6_hierarchical_packing
from .pieces import op13_prefix_table
from .pii import op1_surrogates
from .prefix_hash import op9_prefix_fingerprints
from .probminhash import op10_probminhash
from .quality import op7_ordinal_quality
from .repair_codec import op3_repair_tokens
from .runs import op11_grammar_runs
from .substrings import op4_block_anchors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogates,
        op2_seeded_alignment,
        op3_repair_tokens,
        op4_block_anchors,
        op5_hyperdimensional_language,
        op6_hierarchical_packing,
        op7_ordinal_quality,
        op8_merkle_fixity,
        op9_prefix_fingerprints,
        op10_probminhash,
        op11_grammar_runs,
        op12_galloping_alignment,
        op13_prefix_table,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_merkle_fixity": OP8_SQL}
