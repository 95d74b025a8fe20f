"""All training-data queries (importing the operator modules fills the registry)."""

from __future__ import annotations

from prlens.llm import (  # noqa: F401
    alignment, chat, class_lm, decontaminate, exact_dedup, language_id, license_scan, materialise, near_dedup, packing,
    prefix_trie, sharding, vector_search,
)
from prlens.llm.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
