"""Every query of the library by name, with its SQL form where it has one."""

from __future__ import annotations

from mnemo.plans import check_queries, index_queries, order_queries, ranking_queries, recall_queries, source_queries, state_queries  # noqa: F401
from mnemo.plans.registry import ORACLES, QUERIES  # noqa: F401
