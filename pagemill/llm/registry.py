"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["simhash", "decontaminate", "langid", "bpe", "pii", "wordlm", "quality", "huffman", "suffix", "chroma"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), "ORACLE_SQL", {})
    return out
