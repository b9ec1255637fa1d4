"""All queries of the library and their SQL; the corpus operators register their own."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "rules", "spatial", "text", "workflow", "landuse", "sources", "streams")

PAIRS: dict = {}
for _name in MODULES:
    try:
        PAIRS |= import_module(f"{__package__}.plans.{_name}").PAIRS
    except ModuleNotFoundError as missing:
        if missing.name != f"{__package__}.plans.{_name}":
            raise

QUERIES = {name: run for name, (run, _) in PAIRS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in PAIRS.items() if sql}
