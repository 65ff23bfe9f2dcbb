"""Importing this module registers every query."""

from curvemill.plans import q_catalogue, q_classify, q_clean, q_detrend, q_evaluate, q_features, q_jobs, q_search  # noqa: F401
from curvemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
