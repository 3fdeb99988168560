"""Registered queries over the given tables."""

from tidepanel.catalog import (  # noqa: F401
    evaluation_queries,
    feature_queries,
    ingest_queries,
    panel_queries,
    rank_queries,
    split_queries,
    universe_queries,
)
from tidepanel.catalog.flagship import flagship  # noqa: F401
from tidepanel.catalog.registry import ENTRIES  # noqa: F401
