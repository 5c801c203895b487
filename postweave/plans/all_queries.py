"""Importing this module registers every query."""

from postweave.plans import (  # noqa: F401
    collect_queries,
    document_queries,
    markup_queries,
    relay_queries,
    search_queries,
    source_queries,
)
