"""Queries: operators applied to tables, each with the SQL that checks it where SQL can express it."""

from importlib import import_module

MODULES = ("scan_queries", "search_queries", "audit_queries", "catalog_queries", "graph_queries", "cyclic_queries", "segment_queries", "stateful_queries", "journal_queries", "index_queries", "validation_queries", "rendered_queries", "sources_queries", "store_queries", "found_queries", "code_queries", "manifest_queries", "stream_queries", "report_queries", "project_queries", "review_queries", "detect_queries", "facts_queries", "records_queries", "collect_queries")


def load() -> None:
    """Import all query modules, so that they register."""
    for name in MODULES:
        import_module(f"stratalens.plans.{name}")
