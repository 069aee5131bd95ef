"""Every registered query, by importing the modules that register them."""

from __future__ import annotations

from dialoom.plans import file_queries, interval_queries, metric_queries, relabel_queries, retrieval_queries, sequence_queries, store_queries, summary_queries, text_queries, vector_queries  # noqa: F401
from dialoom.plans.registry import ORACLES, QUERIES  # noqa: F401
