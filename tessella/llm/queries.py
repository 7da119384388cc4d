"""All queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: The modules that have queries, by the number of their operator.
MODULES = ("decontamination", "bpe", "language", "chat", "sharding", "lm_scoring", "quality", "token_files", "line_dedup", "jaccard_join", "packing", "centroids", "alignment")


def collected() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tessella.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
