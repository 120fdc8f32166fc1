"""Queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from medweave.llm import bpe, chat_format, hard_negatives, language_id, line_dedup, near_dedup, packing, piece_sampling, prefix_trie, quality_rules, token_counts, token_files, vp_tree  # noqa: F401
from medweave.llm.common import ORACLE, QUERIES  # noqa: F401
