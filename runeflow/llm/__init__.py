"""Operators for preparing training corpora; nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ("windows", "suffixes", "near", "neighbours", "tokens", "shuffle", "mixing", "decontaminate", "language", "quality", "oracles")


def queries() -> dict:
    """Every query of the subpackage: name -> function of (spark, sf_dir)."""
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLE.items()}
