"""Named queries over the standard test tables."""

from twinproof.catalog import fairness_queries, large_queries, prepare_queries, privacy_queries, record_queries, score_queries, source_queries, stream_queries, utility_queries
from twinproof.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fairness_queries", "large_queries", "prepare_queries", "privacy_queries", "record_queries", "score_queries", "source_queries", "stream_queries", "utility_queries"]
