"""Imports every query module so that the registry is filled."""

from . import q_jets, q_joins, q_models, q_prep, q_reports, q_sources, q_stats  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
