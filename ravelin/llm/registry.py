"""All queries of this subpackage, with their SQL where there is one."""

from importlib import import_module

MODULES = ["fingerprints", "url_filters", "mixing", "packing", "near_dedup", "kneser_ney", "quality_rules", "token_counts", "language_id", "recurrent_lm"]
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = import_module(f"ravelin.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
