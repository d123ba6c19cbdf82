"""Registered queries, the views they run on, and their SQL twins."""

from perinuc.plans import (  # noqa: F401
    q_curves,
    q_detection,
    q_pairing,
    q_pixels,
    q_profiles,
    q_sources,
    q_stability,
    q_summary,
)
from perinuc.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
