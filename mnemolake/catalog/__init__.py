"""All registered queries by family."""

from __future__ import annotations

import importlib

FAMILIES = ("pairing", "cleaning", "identity", "sessions", "lexical", "vectors", "fusion", "indexing", "upkeep", "lineage", "evaluation", "imports", "streams")


def all_queries():
    found = {}
    for family in FAMILIES:
        module = importlib.import_module(f"mnemolake.catalog.{family}")
        for name, query in module.reg.items.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found
