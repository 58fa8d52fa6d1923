"""Candidate-document analytics as Spark jobs.

Everything here takes and returns DataFrames; model calls are batch functions
that the caller supplies.
"""

from vitaeflow.session import configure

__all__ = ["configure"]
