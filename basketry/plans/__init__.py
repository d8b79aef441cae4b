"""Registered queries: each couples a Spark plan with its independent SQL statement."""

from basketry.plans import (  # noqa: F401  (each import registers its queries)
    q_behaviour,
    q_charts,
    q_cleaning,
    q_cluster,
    q_encode,
    q_features,
    q_profiling,
    q_relations,
    q_sales,
    q_segments,
    q_sequences,
    q_sources,
    q_text,
)
from basketry.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
