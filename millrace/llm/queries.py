"""Registered queries of the language-model corpus operators."""

from __future__ import annotations

import importlib
import importlib.util

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PARTS = ["link_queries", "tokens_queries", "chat_queries", "level_queries", "cut_queries", "pii_queries", "credential_queries", "parse_queries"]

for _name in _PARTS:
    if importlib.util.find_spec(f"millrace.llm.{_name}") is not None:
        _m = importlib.import_module(f"millrace.llm.{_name}")
        QUERIES.update(_m.QUERIES)
        ORACLES.update(_m.ORACLES)
