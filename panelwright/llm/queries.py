"""The queries of the training-data operators and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module; each module holds a function of the query's name and may hold ORACLE_SQL.
MODULES = {
    "op1_byte_bpe": "bpe",
    "op2_multiset_fingerprint": "fingerprint",
    "op3_toxic_segments": "toxicity",
    "op4_minhash_dedup": "minhash",
    "op5_decontaminate": "decontaminate",
    "op6_language_id": "langid",
    "op7_url_rules": "urlrules",
    "op8_line_dedup": "linededup",
    "op9_secret_scan": "secrets",
    "op10_suffix_dedup": "suffix",
    "op11_importance_resampling": "resample",
    "op12_chat_format": "chat",
    "op13_periodic_runs": "periodic",
}


def _module(name: str):
    return importlib.import_module(f"panelwright.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
