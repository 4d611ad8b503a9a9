"""Operators of a training-data pipeline and their registered queries.

Nothing outside this package imports it.  ``registry()`` returns the queries
(``opN_<name>``) and their SQL; each module holds one operator and its query.
"""

from __future__ import annotations

import importlib

MODULES = ("packing", "warc", "quality", "chat", "secret_scan", "minhash", "token_rollup", "itq", "pii",
           "decontaminate", "mixing", "collocations", "lexical")


def registry() -> tuple[dict, dict]:
    """(queries, oracle SQL) of every operator module, by query name."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"larkspur.llm.{name}")
        queries[module.QUERY_NAME] = module.query
        if module.ORACLE_SQL:
            oracles[module.QUERY_NAME] = module.ORACLE_SQL
    return queries, oracles
