"""All registered queries with their SQL twins."""

from __future__ import annotations

from evispark.plans import q_bundle, q_evaluation, q_experiment, q_flows, q_gates, q_lexical, q_retrieval, q_topics  # noqa: F401
from evispark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
