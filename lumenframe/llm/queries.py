"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: module of this package that holds it.
MODULES = {
    "op1_bpe": "bpe",
    "op2_media": "media",
    "op3_quality": "quality",
    "op4_secrets": "secrets",
    "op5_pii": "pii",
    "op6_langid": "langid",
    "op7_mix": "mix",
    "op8_ngram_join": "ngram_join",
    "op9_warc": "warc",
    "op10_ann": "ann",
}


def load(name: str):
    """A query, imported with what its module needs."""
    return getattr(import_module(f".{MODULES[name]}", __package__), name)


def queries() -> dict:
    return {name: load(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
