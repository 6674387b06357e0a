"""Queries over the test tables and the SQL that must give the same rows."""

from checks import evaluation, jobs, normalization, sequences, sources, splits, text, vocab  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
