"""All registered queries."""

from __future__ import annotations

from sharelens.plans import (  # noqa: F401  (importing registers the queries)
    activity_queries,
    cluster_queries,
    demography_queries,
    flagship,
    link_queries,
    score_queries,
    storage_queries,
    text_queries,
    vector_queries,
)
from sharelens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
