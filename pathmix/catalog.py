"""The queries of the engine's own operators and the SQL each must equal."""

from .plans import flow_queries, graph_queries, model_queries, path_queries, report_queries, rollout_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
