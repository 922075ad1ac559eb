"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "syncmers", "sharding", "line_dedup", "substring_dedup", "simhash", "host_rules", "toxicity", "token_files", "byte_bpe")


def queries() -> dict:
    return {name: query for module in MODULES for name, query in import_module(f"weir.llm.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in import_module(f"weir.llm.{module}").ORACLE_SQL.items()}
