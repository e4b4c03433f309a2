"""Registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op8_bpe
from .decontam import op1_decontamination
from .html import op10_html_extraction
from .linededup import op2_line_dedup
from .merkle import ORACLE as MERKLE_SQL
from .merkle import op13_merkle_manifest
from .neardup import op4_minhash_near_dedup
from .quality import op5_quality_classifier
from .rules import op7_quality_rules
from .sharding import op3_sharding
from .simhash import op11_simhash_near_dedup
from .substrings import op6_substring_dedup
from .suffixtree import op9_suffix_tree_scoring
from .whitening import op12_embedding_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_suffix_tree_scoring": op9_suffix_tree_scoring,
    "op10_html_extraction": op10_html_extraction,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op13_merkle_manifest": MERKLE_SQL}
