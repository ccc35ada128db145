"""All registered queries."""

from barograph.plans import aggregate_queries, feature_queries, live_queries, relational_queries, routing_queries, sequence_queries, store_queries
from barograph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregate_queries", "feature_queries", "live_queries", "relational_queries", "routing_queries", "sequence_queries", "store_queries"]
