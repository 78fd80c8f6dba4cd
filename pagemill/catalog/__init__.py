"""The registered queries, grouped by the tables and operators they exercise."""

import importlib


def load():
    """Import every query module and return the registry."""
    for name in ("text_queries", "page_queries", "table_queries", "import_queries", "source_queries", "known_queries", "option_queries"):
        importlib.import_module(f"pagemill.catalog.{name}")
    return importlib.import_module("pagemill.catalog.registry")
