"""All queries outside the training-data subpackage, by name, with their DuckDB counterparts."""

from . import archive_queries, bar_queries, board_queries, calendar_queries, flow_queries, graph_queries, indicator_queries, market_queries, panel_queries, regime_queries, setup_queries, signal_queries, stat_queries, stream_queries, study_queries, swing_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
