"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_chat_windows": "chat",
    "op2_multi_index_neighbours": "multi_index",
    "op3_substring_dedup": "substrings",
    "op4_mtree_top_scores": "mtree",
    "op5_jaccard_join": "shingles",
    "op6_secret_scan": "secrets",
    "op7_sentencepieces": "sentencepieces",
    "op8_line_chunks": "linechunks",
    "op8_repeated_passages": "linechunks",
    "op9_language_id": "langid",
    "op10_packing": "packing",
    "op11_vector_codes": "vector_codes",
    "op12_decontamination": "decontamination",
    "op13_importance_resampling": "importance",
}
#: Twins that are not called ORACLE_SQL, where a module has two queries.
TWINS = {"op8_repeated_passages": "PASSAGES_SQL"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"mnemolake.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"mnemolake.llm.{module}"), TWINS.get(name, "ORACLE_SQL"), None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
