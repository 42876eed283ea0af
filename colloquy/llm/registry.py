"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import importlib

#: Query name -> module that defines a function of that name and, where SQL can express it, its text by the name SQL.
QUERIES = {
    "op1_ngram_join": "ngram_join",
    "op2_language_id": "language_id",
    "op3_sstable_token_ids": "sstable",
    "op4_decontaminate": "decontaminate",
    "op5_html_main_text": "html_text",
    "op6_byte_bpe": "byte_bpe",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_suffix_tree_lm": "suffix_tree_lm",
    "op9_graph_ann": "graph_ann",
    "op10_toxicity": "toxicity",
    "op11_tandem_runs": "tandem_runs",
    "op12_token_counts": "token_counts",
    "op13_kdtree_clusters": "kdtree_clusters",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"colloquy.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"colloquy.llm.{module}"), "SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
