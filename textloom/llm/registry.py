"""The queries of the corpus operators and, where SQL can express one, their SQL."""

from __future__ import annotations

import importlib
import importlib.util

_MODULES = ["hmm_lm", "token_counts", "line_dedup", "decontaminate", "near_dedup", "warc_fixity", "toxicity", "language_id", "byte_bpe", "progressive_jpeg"]


def _modules() -> list:
    found = [importlib.util.find_spec(f"textloom.llm.{name}") for name in _MODULES]
    return [importlib.import_module(f"textloom.llm.{name}") for name, spec in zip(_MODULES, found, strict=True) if spec]


def queries() -> dict:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in getattr(module, "SQL", {}).items()}
