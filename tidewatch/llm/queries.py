"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import importlib

#: Query name -> module that holds query() and, if SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_minhash_neardup": "neardup",
    "op3_license_scan": "licenses",
    "op4_suffix_tree_lm": "suffixlm",
    "op5_cube_mixing": "mixing",
    "op6_bpe_speculative": "bpe",
    "op7_language_id": "langid",
    "op8_token_counts": "tokencount",
    "op9_permutation_index": "permindex",
    "op10_embedding_neardup": "tiledsim",
    "op11_filter_audit": "filteraudit",
    "op12_hard_negatives": "hardnegatives",
    "op13_merkle_fingerprint": "merkle",
}


#: Of operators whose whole result SQL can't give: query of the part that it can -> (module, function, name of its SQL).
PARTS = {
    "license_base": ("licenses", "base", "BASE_SQL"),
    "language_model_base": ("suffixlm", "base", "BASE_SQL"),
    "mixing_targets": ("mixing", "target_query", "TARGETS_SQL"),
    "neighbours_checked": ("permindex", "checked", "CHECKED_SQL"),
    "neighbours_recall": ("permindex", "recall", "RECALL_SQL"),
}


def _module(name: str):
    return importlib.import_module(f"tidewatch.llm.{name}")


def queries() -> dict:
    found = {name: (lambda spark, sf_dir, module=module: _module(module).query(spark, sf_dir)) for name, module in MODULES.items()}
    return found | {name: (lambda spark, sf_dir, module=module, function=function: getattr(_module(module), function)(spark, sf_dir)) for name, (module, function, _) in PARTS.items()}


def oracle_sql() -> dict[str, str]:
    whole = {name: sql for name, module in MODULES.items() if (sql := getattr(_module(module), "ORACLE_SQL", None))}
    return whole | {name: getattr(_module(module), sql) for name, (module, _, sql) in PARTS.items()}
