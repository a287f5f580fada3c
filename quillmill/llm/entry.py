"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

#: query -> (module, SQL's name or None)
_QUERIES = {
    "op1_chat_format": ("chat", "OP1_SQL"),
    "op2_token_planes": ("tokens", None),
    "op3_secret_scan": ("secrets", None),
    "op4_minhash": ("minhash", None),
    "op5_quality_rules": ("quality_rules", "OP5_SQL"),
    "op6_lm_score": ("language_model", None),
    "op7_line_dedup": ("line_dedup", "OP7_SQL"),
    "op8_packing": ("packing", None),
    "op9_quality_net": ("quality_net", None),
    "op10_decontaminate": ("decontaminate", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f".{module}", __package__), sql) for name, (module, sql) in _QUERIES.items() if sql}
