"""The registered queries, each with the SQL that must give the same rows."""

from retailcast.queries import evaluation, jobs, quality, shaping, storage  # noqa: F401
from retailcast.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
