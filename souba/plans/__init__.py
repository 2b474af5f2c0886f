"""Registered queries over the driver tables and the end-to-end jobs."""

from __future__ import annotations


def _load():
    from souba.plans import catalog_queries, market_queries, model_queries, page_queries, stream_queries, text_queries  # noqa: F401
    from souba.plans import registry
    return registry


def all_queries() -> dict:
    """Every registered query by name."""
    return dict(_load().QUERIES)


def all_oracles() -> dict[str, str]:
    """Oracle SQL by query name."""
    return dict(_load().ORACLES)
