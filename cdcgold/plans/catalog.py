"""Importing this module registers every query."""

from cdcgold.plans import checking, decoding, folds, measuring, merges, reads, streams  # noqa: F401
from cdcgold.plans.registry import QUERIES

__all__ = ["QUERIES"]
