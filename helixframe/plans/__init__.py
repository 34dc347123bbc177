"""Registered queries: importing this package fills the registry."""

from helixframe.plans import q_io, q_metrics, q_splits, q_tokens, q_vectors  # noqa: F401
from helixframe.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
