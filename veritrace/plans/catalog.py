"""All registered queries; importing this module fills the registry."""

from veritrace.plans import (  # noqa: F401
    answer_queries, metric_queries, process_queries, source_queries, stream_queries, text_queries,
)
from veritrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
